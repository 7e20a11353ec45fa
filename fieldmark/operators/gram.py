"""One pass of cross products: the sums that correlations, regressions, reliability and
factor analysis share. Rows are reduced in Spark; the driver gets a small matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a matrix at most: the driver's part is their square.
MOST = 200


@dataclass
class Gram:
    """``n`` complete rows (or their weight), means, and centred cross products."""

    names: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray

    def cov(self) -> np.ndarray:
        return self.cross / (self.n - 1)

    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.cross))
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.cross / np.outer(sd, sd)

    def sub(self, names: list[str]) -> Gram:
        at = [self.names.index(x) for x in names]
        return Gram(names, self.n, self.mean[at], self.cross[np.ix_(at, at)])

    def raw(self) -> np.ndarray:
        """Uncentred products of a leading 1 and the columns."""
        m = np.concatenate([[1.0], self.mean])
        out = self.n * np.outer(m, m)
        out[1:, 1:] += self.cross
        return out


def gram(df: DataFrame, columns: dict[str, Column], weight: Column | None = None, centre: dict[str, float] | None = None) -> Gram:
    """Cross products over the rows where every column is there.

    Products are taken about the first pass's means, so large means cost no digits. Where a number near
    each column's mean is known, ``centre`` saves that pass; the exact means follow from the sums.
    """
    if len(columns) > MOST:
        raise ValueError(f"more than {MOST} columns")
    names = list(columns)
    at = [f"c{k}" for k in range(len(names))]
    rows = df.select(*[c.cast("double").alias(a) for a, c in zip(at, columns.values(), strict=True)], (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"))
    rows = rows.dropna()
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
    if centre is not None:
        near = np.array([float(centre[c]) for c in names])
        dev = [F.col(a) - F.lit(float(m)) for a, m in zip(at, near, strict=True)]
        got = rows.agg(F.sum("w"), *[F.sum(d * F.col("w")) for d in dev], *[F.sum(dev[i] * dev[j] * F.col("w")) for i, j in pairs]).first()
        return _about(names, got, near, pairs)
    first = rows.agg(F.sum("w"), *[F.sum(F.col(a) * F.col("w")) for a in at]).first()
    n = first[0] or 0.0
    if not n:
        return Gram(names, 0.0, np.full(len(at), np.nan), np.full((len(at), len(at)), np.nan))
    mean = np.array([x / n for x in first[1:]])
    dev = [F.col(a) - F.lit(float(m)) for a, m in zip(at, mean, strict=True)]
    got = rows.agg(*[F.sum(dev[i] * dev[j] * F.col("w")) for i, j in pairs]).first()
    cross = np.zeros((len(at), len(at)))
    for (i, j), v in zip(pairs, got, strict=True):
        cross[i, j] = cross[j, i] = v
    return Gram(names, float(n), mean, cross)


def _about(names: list[str], got: tuple, near: np.ndarray, pairs: list[tuple[int, int]]) -> Gram:
    """From the weight, sums and products of differences from ``near``."""
    k, n = len(names), got[0] or 0.0
    if not n:
        return Gram(names, 0.0, np.full(k, np.nan), np.full((k, k), np.nan))
    away, cross = np.array(got[1 : 1 + k]) / n, np.zeros((k, k))
    for (i, j), v in zip(pairs, got[1 + k :], strict=True):
        cross[i, j] = cross[j, i] = v - n * away[i] * away[j]
    return Gram(names, float(n), near + away, cross)


def grams(df: DataFrame, key: str, columns: list[str], centre: dict[str, float]) -> dict[object, Gram]:
    """Cross products of each value of ``key``, all in one aggregation.

    ``centre``: a number near each column's mean, about which products are taken; the exact
    means follow from the sums. Values of the key are few, as the caller knows.
    """
    if len(columns) > MOST:
        raise ValueError(f"more than {MOST} columns")
    dev = [F.col("`" + c.replace("`", "``") + "`").cast("double") - F.lit(float(centre[c])) for c in columns]
    pairs = [(i, j) for i in range(len(dev)) for j in range(i, len(dev))]
    rows = df.select(F.col(key).alias("key"), *[d.alias(f"d{k}") for k, d in enumerate(dev)]).dropna(subset=[f"d{k}" for k in range(len(dev))])
    sums = [F.sum(f"d{k}") for k in range(len(dev))] + [F.sum(F.col(f"d{i}") * F.col(f"d{j}")) for i, j in pairs]
    out = {}
    for r in rows.groupBy("key").agg(F.count("*").cast("double"), *sums).collect():
        n, away = r[1], np.array(r[2 : 2 + len(dev)]) / r[1]
        cross = np.zeros((len(dev), len(dev)))
        for (i, j), v in zip(pairs, r[2 + len(dev) :], strict=True):
            cross[i, j] = cross[j, i] = v - n * away[i] * away[j]
        out[r[0]] = Gram(list(columns), n, away + np.array([centre[c] for c in columns]), cross)
    return out
