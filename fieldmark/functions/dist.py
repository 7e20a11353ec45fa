"""Distribution functions of the test statistics: normal, t, chi-squared, F (central and
non-central) and the studentised range. They finish a few numbers on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _solve(f: Callable[[float], float], p: float, low: float, high: float) -> float:
    """x with f(x) = p for an increasing f; the bracket widens as needed."""
    while f(high) < p and high < 1e300:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < p else (low, mid)
    return (low + high) / 2


def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p <= 0 else math.inf
    return _solve(norm_cdf, p, -40.0, 40.0)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * out)


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, else a continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for k in range(1, 5000):
        b += 2
        top = -k * (k - a)
        d = 1 / ((top * d + b) or 1e-300)
        c = (b + top / c) or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return max(0.0, 1 - front * out)


def t_sf2(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    x = _solve(lambda t: 1 - t_sf2(t, df) / 2, max(p, 1 - p), 0.0, 50.0)
    return x if p > 0.5 else -x


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2) if df > 0 else math.nan


def f_cdf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2)) if f > 0 else 0.0


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def ncf_cdf(f: float, d1: float, d2: float, nc: float) -> float:
    """Non-central F: Poisson-weighted betas, summed outward from the likeliest term."""
    if f <= 0:
        return 0.0
    x, half = d1 * f / (d1 * f + d2), nc / 2
    mid = int(half)
    total = 0.0
    for step, k in ((1, mid), (-1, mid - 1)):
        while k >= 0:
            w = math.exp(-half + (k * math.log(half) if half else (0.0 if k == 0 else -math.inf)) - math.lgamma(k + 1))
            total += w * beta_inc(d1 / 2 + k, d2 / 2, x)
            if w < 1e-17 and abs(k - mid) > 10:
                break
            k += step
    return min(1.0, total)


def ncf_nc(f: float, d1: float, d2: float, p: float) -> float:
    """The non-centrality at which ``ncf_cdf`` is ``p`` (0 if it never is)."""
    if ncf_cdf(f, d1, d2, 0.0) <= p:
        return 0.0
    return _solve(lambda nc: -ncf_cdf(f, d1, d2, nc), -p, 0.0, 10.0)


def tukey_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range by Gauss-Legendre quadrature."""
    if q <= 0:
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = z * 8, wz * 8
    erf = np.vectorize(math.erf)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = 0.5 * (1 + erf(z / math.sqrt(2)))

    def range_cdf(w: float) -> float:
        low = 0.5 * (1 + erf((z - w) / math.sqrt(2)))
        return float(k * (wz * phi * (cdf - low) ** (k - 1)).sum())

    if df > 5000:
        return max(0.0, 1 - range_cdf(q))
    s, ws = np.polynomial.legendre.leggauss(64)
    spread = 8 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - spread), 1 + spread
    s, ws = (s + 1) / 2 * (high - low) + low, ws * (high - low) / 2
    log = (df / 2) * math.log(df / 2) + math.log(2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, max(0.0, 1 - (ws * np.exp(log) * [range_cdf(q * x) for x in s]).sum())))


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p by Royston's approximation (AS R94), 3 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(ss)
    if n > 3:
        last = a[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
        if n > 5:
            prev = a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
            a = m / math.sqrt(phi)
            a[-1], a[0], a[-2], a[1] = last, -last, prev, -prev
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = last, -last
    else:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    total = float(((x - x.mean()) ** 2).sum())
    if total <= 0:
        return 1.0, 1.0
    w = min(1.0, float(a @ x) ** 2 / total)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(max(g - y, 1e-300))
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 1 - norm_cdf((y - mu) / sd)
