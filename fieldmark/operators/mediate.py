"""Mediation and moderation from cross products."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import dist
from fieldmark.functions.columns import number_of
from fieldmark.operators.gram import Gram, gram
from fieldmark.operators.regress import solve

REPLICATES, SEED = 5000, 20260926
#: Rows of a bucket, where none are equal; rows of a block; the largest count drawn from a table.
BUCKET, BLOCK, MOST = 512, 64, 200


class Poisson:
    """Draws of one mean, from 16 random bits each.

    The 65536 slots hold each value as often as its probability says, in whole slots. What this
    leaves over makes a second distribution; a draw comes from it with the probability ``rest``, so that
    draws have the probabilities of a Poisson distribution, as exactly as doubles tell them.
    """

    def __init__(self, mean: int) -> None:
        k = np.arange(mean + 12 * math.isqrt(mean) + 24)
        p = np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1.0) for x in k]))
        slots = np.floor(p * 65536).astype(np.int64)
        slots[np.argsort(-p, kind="stable")[: 65536 - slots.sum()]] += 1
        self.rest = 1 - float(np.min((p * 65536)[slots > 0] / slots[slots > 0]))
        self.values = np.repeat(k.astype(np.uint16), slots)
        left = np.cumsum(np.maximum(p - (1 - self.rest) * slots / 65536, 0))
        self.upto = left / left[-1]

    def draw(self, rng: np.random.Generator, size: int) -> np.ndarray:
        out = self.values.take(rng.bit_generator.random_raw(-(-size // 4)).view(np.uint16)[:size])
        some = rng.choice(size, rng.binomial(size, self.rest), replace=False, shuffle=False)
        out[some] = np.searchsorted(self.upto, rng.random(len(some)), side="right")
        return out


def _bucket_sums(rows: np.ndarray, rng: np.random.Generator, replicates: int, known: dict[int, Poisson]) -> np.ndarray:
    """Sums over one bucket's rows (columns, then count) of their products, upper triangles, by replicate."""
    x = np.column_stack([np.ones(len(rows)), rows[:, :-1]])
    i, j = np.triu_indices(x.shape[1])
    products, n = x[:, i] * x[:, j], rows[:, -1].astype(np.int64)
    total = np.zeros((len(i), replicates))
    ends = np.flatnonzero(np.diff(n, append=-1)) + 1
    for at, end in zip([0, *ends[:-1]], ends, strict=True):  # rows of equal count
        mean = int(n[at])
        for a in range(at, end, BLOCK):
            size = min(BLOCK, end - a) * replicates
            if mean > MOST:
                w = rng.poisson(mean, size)
            else:
                w = (known.get(mean) or known.setdefault(mean, Poisson(mean))).draw(rng, size)
            total += products[a : min(a + BLOCK, end)].T @ w.reshape(-1, replicates).astype(np.float64)
    return total


def _poisson_grams(df: DataFrame, names: list[str], n: int, replicates: int, seed: int) -> np.ndarray:
    """Cross products of (1, columns) of ``n`` complete rows under Poisson bootstrap weights, one per replicate.

    Equal rows are counted first. Rows are dealt to buckets by their values and stand in order
    in them; a bucket's weights come from one generator, so they are the same however the rows lie.
    Each task returns ``replicates`` small matrices; their sums over tasks are added in Spark.
    """
    rows = df.select(*[number_of(df, c).alias(f"c{k}") for k, c in enumerate(names)]).dropna()
    values = rows.columns
    rows = rows.groupBy(*values).agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64(*values), F.lit(-(-n // BUCKET))))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "n", *values).select("bucket", *values, F.col("n").cast("double"))
    i, j = np.triu_indices(len(names) + 1)

    def run(batches):
        total, known, left = np.zeros((len(i), replicates)), {}, None

        def add(rows):
            for own in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                total[:] += _bucket_sums(own[:, 1:], np.random.default_rng([seed, int(own[0, 0])]), replicates, known)

        for pdf in batches:
            got = pdf.to_numpy(np.float64)
            got = got if left is None else np.concatenate([left, got])
            last = np.searchsorted(got[:, 0], got[-1, 0])  # the last bucket may go on in the next batch
            left = got[last:]
            if last:
                add(got[:last])
        if left is not None:
            add(left)
            yield pd.DataFrame({"rep": np.arange(replicates), "m": list(total.T)})

    per_task = rows.mapInPandas(run, "rep long, m array<double>")
    summed = per_task.groupBy("rep").agg(F.array(*[F.sum(F.element_at("m", at + 1)) for at in range(len(i))]).alias("m"))
    got = np.array(summed.orderBy("rep").toPandas()["m"].tolist())  # one small matrix per replicate
    grams = np.zeros((len(got), len(names) + 1, len(names) + 1))
    grams[:, i, j] = grams[:, j, i] = got
    return grams


def _slopes(grams: np.ndarray, xs: list[int], y: int) -> np.ndarray:
    at = [0, *xs]
    return np.linalg.solve(grams[:, at][:, :, at], grams[:, at, y][:, :, None])[:, :, 0]


def paths(df: DataFrame, x: str, m: str, y: str, covariates: tuple[str, ...] = (), alpha: float = 0.05) -> dict:
    """Paths a (x to m), b (m to y beside x), c (x to y) and direct (x to y beside m)."""
    g = gram(df, {c: number_of(df, c) for c in (x, m, y, *covariates)})
    if g.n < 20:
        return {"n": int(g.n)}
    both = solve(g, y, [x, m, *covariates], alpha)["coefficients"]
    a, c = (solve(g, to, [x, *covariates], alpha)["coefficients"][1] for to in (m, y))
    return {"n": int(g.n), "a": a, "b": both[2], "c": c, "direct": both[1]}


def mediation(df: DataFrame, x: str, m: str, y: str, covariates: tuple[str, ...] = (), alpha: float = 0.05, replicates: int = REPLICATES, seed: int = SEED) -> dict:
    """``paths``, the indirect effect with its bootstrap interval, and a label.

    Needs 20 complete rows. The interval is a percentile interval over Poisson
    bootstrap replicates, so replicates need no copy of the rows.
    """
    out = paths(df, x, m, y, covariates, alpha)
    if "a" not in out:
        return out | {"label": "too few rows"}
    grams = _poisson_grams(df, [x, m, y, *covariates], out["n"], replicates, seed)
    extra = list(range(4, 4 + len(covariates)))
    draws = _slopes(grams, [1, *extra], 2)[:, 1] * _slopes(grams, [1, 2, *extra], 3)[:, 2]
    low, high = np.percentile(draws, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    found = low > 0 or high < 0
    label = "no mediation" if not found else "full mediation" if out["direct"]["p"] >= alpha else "partial mediation"
    indirect = out["a"]["b"] * out["b"]["b"]
    return out | {"indirect": indirect, "ci_low": float(low), "ci_high": float(high), "share": indirect / out["c"]["b"] if out["c"]["b"] else None, "significant": bool(found), "label": label}


def _with_product(g3: DataFrame, x: str, w: str, y: str, covariates: tuple[str, ...]) -> tuple[Gram, float, float]:
    cols = {c: number_of(g3, c) for c in (x, w, y, *covariates)}
    base = gram(g3, cols)
    mx, mw = float(base.mean[0]), float(base.mean[1])
    centred = {"x": cols[x] - F.lit(mx), "w": cols[w] - F.lit(mw)}
    return gram(g3, centred | {"xw": centred["x"] * centred["w"], "y": cols[y]} | {c: cols[c] for c in covariates}), mx, mw


def moderation(df: DataFrame, x: str, w: str, y: str, covariates: tuple[str, ...] = (), alpha: float = 0.05) -> dict:
    """The interaction of two centred predictors, simple slopes at -1, 0 and +1 sd of the
    moderator, and the moderator values where the slope's significance turns. Needs 30 rows."""
    g, _, mw = _with_product(df, x, w, y, covariates)
    if g.n < 30:
        return {"n": int(g.n), "label": "too few rows"}
    fit = solve(g, "y", ["x", "w", "xw", *covariates], alpha)
    b = [r["b"] for r in fit["coefficients"]]
    cov = fit["inverse"] * fit["mse"]
    sd = math.sqrt(g.cross[1, 1] / (g.n - 1))
    t_crit = dist.t_ppf(1 - alpha / 2, fit["df"])
    slopes = []
    for k in (-1, 0, 1):
        at = k * sd
        slope, se = b[1] + b[3] * at, math.sqrt(max(0.0, cov[1, 1] + 2 * at * cov[1, 3] + at * at * cov[3, 3]))
        slopes.append({"sd": k, "w": mw + at, "slope": slope, "se": se, "t": slope / se, "p": dist.t_sf2(slope / se, fit["df"]), "ci_low": slope - t_crit * se, "ci_high": slope + t_crit * se})
    qa, qb, qc = b[3] ** 2 - t_crit**2 * cov[3, 3], 2 * (b[1] * b[3] - t_crit**2 * cov[1, 3]), b[1] ** 2 - t_crit**2 * cov[1, 1]
    root = qb * qb - 4 * qa * qc
    turns = sorted(mw + (-qb + s * math.sqrt(root)) / (2 * qa) for s in (-1, 1)) if root >= 0 and qa else []
    return {"n": int(g.n), "interaction": fit["coefficients"][3], "r2": fit["r2"], "slopes": slopes, "turning_points": turns}
