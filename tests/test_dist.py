import numpy as np
import pytest

from fieldmark.functions import dist


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (lambda: dist.norm_ppf(0.975), 1.959964),
        (lambda: dist.t_ppf(0.975, 10), 2.228139),
        (lambda: dist.t_sf2(2.086, 20), 0.05),
        (lambda: dist.chi2_sf(3.841459, 1), 0.05),
        (lambda: dist.f_sf(4.256495, 2, 9), 0.05),
        (lambda: dist.f_cdf(4.256495, 2, 9), 0.95),
        (lambda: dist.tukey_sf(3.577935, 3, 20), 0.05),
        (lambda: dist.tukey_sf(3.3145, 3, 1e6), 0.05),
    ],
)
def test_tables(got, want):
    assert got() == pytest.approx(want, abs=2e-4)


def test_shapiro_textbook():
    w, p = dist.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert (w, p) == (pytest.approx(0.7888, abs=1e-3), pytest.approx(0.0067, abs=5e-4))


def test_noncentral_f_inverts():
    nc = dist.ncf_nc(5.0, 2, 30, 0.025)
    assert dist.ncf_cdf(5.0, 2, 30, nc) == pytest.approx(0.025, abs=1e-6)
    assert dist.ncf_cdf(3.0, 2, 20, 0.0) == pytest.approx(dist.f_cdf(3.0, 2, 20))
