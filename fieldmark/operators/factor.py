"""Scale validity: sphericity, sampling adequacy, and factors of one correlation matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions import dist
from fieldmark.functions.columns import col, number
from fieldmark.operators.gram import gram

SEED, SIMULATIONS = 20260926, 100
# Least loading, share of it that makes a second loading count, weak communality.
LOADING, SECOND, WEAK = 0.40, 0.8, 0.30


def bartlett(r: np.ndarray, n: float) -> dict:
    """Bartlett's test that the correlation matrix is an identity."""
    k = len(r)
    sign, logdet = np.linalg.slogdet(r)
    chi2 = -(n - 1 - (2 * k + 5) / 6) * logdet if sign > 0 else math.inf
    dof = k * (k - 1) // 2
    return {"chi2": float(chi2), "df": dof, "p": dist.chi2_sf(chi2, dof) if math.isfinite(chi2) else 0.0}


def kmo(r: np.ndarray) -> tuple[float, np.ndarray]:
    """Overall and per-item sampling adequacy."""
    inv = np.linalg.pinv(r)
    d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    part = -inv / d
    r2, p2 = r**2, part**2
    np.fill_diagonal(r2, 0)
    np.fill_diagonal(p2, 0)
    return float(r2.sum() / (r2.sum() + p2.sum())), r2.sum(0) / (r2.sum(0) + p2.sum(0))


def varimax(loadings: np.ndarray, sweeps: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Kaiser-normalised varimax by planar rotations of each pair of factors."""
    size = np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    x = loadings / np.where(size > 0, size, 1)
    p, k = x.shape
    for _ in range(sweeps):
        turned = 0.0
        for i in range(k):
            for j in range(i + 1, k):
                u, v = x[:, i] ** 2 - x[:, j] ** 2, 2 * x[:, i] * x[:, j]
                a = math.atan2(2 * (u @ v - u.sum() * v.sum() / p), (u @ u - v @ v) - (u.sum() ** 2 - v.sum() ** 2) / p) / 4
                c, s = math.cos(a), math.sin(a)
                x[:, [i, j]] = x[:, [i, j]] @ np.array([[c, -s], [s, c]])
                turned = max(turned, abs(a))
        if turned < tolerance:
            break
    return x * size


def parallel_analysis(spark: SparkSession, n: int, k: int, simulations: int = SIMULATIONS, seed: int = SEED) -> np.ndarray:
    """95th percentiles of the eigenvalues of random data of the same shape.

    Simulations are spread over tasks, each with a stream of its own. The cross products
    of n normal rows are drawn directly (Bartlett's decomposition of a Wishart matrix).
    """

    def run(batches):
        for pdf in batches:
            out = []
            for rep in pdf["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                low = np.tril(rng.standard_normal((k, k)), -1) + np.diag(np.sqrt(rng.chisquare(n - 1 - np.arange(k))))
                w = low @ low.T
                d = np.sqrt(np.diag(w))
                out.append(np.linalg.eigvalsh(w / np.outer(d, d))[::-1].tolist())
            yield pd.DataFrame({"values": out})

    got = spark.range(simulations).mapInPandas(run, "values array<double>")
    return np.array(got.agg(*[F.percentile(F.element_at("values", i + 1), 0.95) for i in range(k)]).first(), float)


def analyse(df: DataFrame, columns: list[str], factors: int | None = None, method: str = "pca", rotate: bool = True, parallel: bool = True, least: float = LOADING) -> dict:
    """Factors of the items' correlations over complete rows.

    ``method``: ``pca`` (components) or ``pa`` (principal axes). The number of factors:
    as given, else by parallel analysis, else eigenvalues over 1.
    """
    g = gram(df, {c: number(col(c)) for c in columns})
    live = [c for c, v in zip(columns, np.diag(g.cross), strict=True) if v > 0]
    if g.n < 5 or len(live) < 3:
        return {"n": int(g.n) if g.n == g.n else 0, "items": live, "error": "too few rows or items"}
    r = g.sub(live).corr()
    values, vectors = np.linalg.eigh(r)
    values, vectors = values[::-1], vectors[:, ::-1]
    random = parallel_analysis(df.sparkSession, int(g.n), len(live)) if parallel and g.n > len(live) + 1 else None
    kaiser = int((values > 1).sum())
    k = factors or (max(1, int(np.argmin(values > random)) if (values <= random).any() else len(live)) if random is not None else max(1, kaiser))
    if method == "pa":
        h = 1 - 1 / np.diag(np.linalg.pinv(r))
        for _ in range(50):
            reduced = r.copy()
            np.fill_diagonal(reduced, h)
            v, q = np.linalg.eigh(reduced)
            load = q[:, ::-1][:, :k] * np.sqrt(np.maximum(v[::-1][:k], 0))
            new = (load**2).sum(axis=1)
            if np.abs(new - h).max() < 1e-6:
                break
            h = new
    else:
        load = vectors[:, :k] * np.sqrt(np.maximum(values[:k], 0))
    if rotate and k > 1:
        load = varimax(load)
    order = np.argsort(-(load**2).sum(axis=0))
    load = load[:, order] * np.where(load[:, order].sum(axis=0) < 0, -1, 1)
    overall, each = kmo(r)
    return {"n": int(g.n), "items": live, "eigenvalues": values.tolist(), "kaiser": kaiser, "random": None if random is None else random.tolist(), "factors": k, "loadings": load, "communality": (load**2).sum(axis=1), "explained": ((load**2).sum(axis=0) / len(live)).tolist(), "kmo": overall, "kmo_items": dict(zip(live, each.tolist(), strict=True)), "bartlett": bartlett(r, g.n), "least": least}


def loading_table(spark: SparkSession, found: dict) -> DataFrame:
    """``item, factor, loading, is_main, is_cross, weak``: one row per item and factor."""
    rows = []
    for i, item in enumerate(found["items"]):
        size = np.abs(found["loadings"][i])
        main = int(size.argmax())
        for f in range(found["factors"]):
            cross = f != main and size[f] >= found["least"] * SECOND
            rows.append((item, f + 1, float(found["loadings"][i, f]), f == main and bool(size[f] >= found["least"]), bool(cross), bool(found["communality"][i] < WEAK)))
    return spark.createDataFrame(rows, "item string, factor int, loading double, is_main boolean, is_cross boolean, weak boolean")


def name_hints(found: dict, top: int = 8) -> dict[int, list[str]]:
    """For each factor the items of the largest loadings, at most ``top``."""
    out = {}
    for f in range(found["factors"]):
        size = np.abs(found["loadings"][:, f])
        out[f + 1] = [found["items"][i] for i in np.argsort(-size, kind="stable")[:top] if size[i] >= found["least"]]
    return out


def by_scale(df: DataFrame, **options) -> dict[str, dict]:
    """One analysis for each scale that the column names show."""
    from fieldmark.operators.profile import scales

    return {stem: analyse(df, items, **options) for stem, items in scales(df).items()}
