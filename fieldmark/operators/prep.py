"""Cleaning of respondent tables. Each step takes a DataFrame and returns a DataFrame and a
line of log; only steps that need a statistic run a job."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.columns import banded_number, col, composite, is_numeric, is_skip_marker, number, reverse_score, sentinel_to_null, skipped
from fieldmark.operators.profile import banded_columns, quantiles

Step = tuple[DataFrame, str]
SKIPPED = "_skipped_"


def drop_empty_columns(df: DataFrame) -> Step:
    """Without columns that hold nothing; one aggregation."""
    return drop_sparse(df, None)


def drop_sparse(df: DataFrame, most_missing_pct: float | None = 50.0) -> Step:
    """Without columns whose share of nulls is over the limit (None: all of them null)."""
    got = df.agg(F.count("*"), *[F.count(col(c)) for c in df.columns]).first()
    n, filled = got[0], got[1:]
    gone = [c for c, k in zip(df.columns, filled, strict=True) if n and (k == 0 if most_missing_pct is None else 100 * (n - k) / n > most_missing_pct)]
    return df.select(*[col(c) for c in df.columns if c not in gone]), f"dropped columns: {', '.join(gone) or 'none'}"


def mark_skips(df: DataFrame) -> Step:
    """Skip markers read into one flag column and dropped; sentinels of text columns to null."""
    markers = [c for c in df.columns if is_skip_marker(c)]
    flag = F.lit(False)
    for c in markers:
        flag = flag | skipped(col(c))
    rest = [c for c in df.columns if c not in markers]
    strings = {c for c, t in df.dtypes if t == "string"}
    out = df.select(*[(sentinel_to_null(col(c)) if c in strings else col(c)).alias(c) for c in rest], *([flag.alias(SKIPPED)] if markers else []))
    return out, f"skip markers: {', '.join(markers) or 'none'}"


def delete_incomplete(df: DataFrame, skip_aware: bool = True) -> Step:
    """Rows without nulls; with a skip flag also the rows that skipped."""
    keep = F.lit(True)
    for c in df.columns:
        if c != SKIPPED:
            keep = keep & col(c).isNotNull()
    if skip_aware and SKIPPED in df.columns:
        keep = keep | F.col(SKIPPED)
    return df.where(keep), "deleted incomplete rows" + " (skips kept)" * (skip_aware and SKIPPED in df.columns)


def pairwise(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def fill(df: DataFrame, columns: list[str], how: str = "mean") -> Step:
    """Nulls filled with the column's mean, median or mode (of tied modes the smallest).

    Mean and median only where the column reads as numbers. Skipped rows stay null.
    """
    aggs, used = [], []
    for c in columns:
        if how == "mode":
            aggs.append(F.mode(col(c), True))
        else:
            aggs.append((F.avg if how == "mean" else F.median)(number(col(c))))
    if not columns:
        return df, "filled nothing"
    got = df.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs)]).first()
    out = df
    for c, v in zip(columns, got, strict=True):
        if v is not None:
            value = number(col(c)) if how != "mode" else col(c)
            new = F.coalesce(value, F.lit(v))
            out = out.withColumn(c, F.when(F.col(SKIPPED), value).otherwise(new) if SKIPPED in df.columns else new)
            used.append(c)
    return out, f"{how} fill: {', '.join(used) or 'none'}"


def band_to_number(df: DataFrame, columns: list[str] | None = None) -> Step:
    """Banded label columns (all labels readable, 2 to 8 of them) as numbers."""
    names = banded_columns(df, columns or [c for c, t in df.dtypes if t == "string"])
    return df.select(*[(banded_number(col(c)) if c in names else col(c)).alias(c) for c in df.columns]), f"bands to numbers: {', '.join(names) or 'none'}"


def reverse(df: DataFrame, rules: str) -> Step:
    """Lines ``variable, maximum``: maximum + 1 - value; the original stays as ``variable_原始``."""
    out, done = df, []
    for line in rules.splitlines():
        m = re.fullmatch(r"\s*(.+?)\s*[,，]\s*([0-9.]+)\s*", line)
        if m and m[1] in df.columns:
            out = out.withColumn(f"{m[1]}_原始", col(m[1])).withColumn(m[1], reverse_score(col(m[1]), float(m[2])))
            done.append(m[1])
    return out, f"reversed: {', '.join(done) or 'none'}"


def composites(df: DataFrame, rules: str) -> Step:
    """One composite per line; a rule with fewer than two known items is skipped."""
    out, done = df, []
    for line in rules.splitlines():
        found = composite(line, out.columns)
        if found:
            out = out.withColumn(*found)
            done.append(found[0])
    return out, f"composites: {', '.join(done) or 'none'}"


def outlier_bounds(df: DataFrame, columns: list[str] | None = None, how: str = "z", least_n: int = 8, least_distinct: int = 6) -> dict[str, tuple[float, float]]:
    """Bounds of each column with enough numbers: mean +- 3 sd, or quartiles +- 1.5 ranges."""
    names = columns or [c for c in df.columns if is_numeric(df, c)]
    if not names:
        return {}
    aggs = []
    for c in names:
        x = number(col(c))
        aggs += [F.count(x), F.count_distinct(x), F.avg(x), F.stddev_samp(x)]
    got = list(df.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs)]).first())
    if how != "z":
        quartiles = {(r["variable"], r["q"]): r["value"] for r in quantiles(df, names, (0.25, 0.75)).collect()}
        for k, c in enumerate(names):
            got[4 * k + 2 : 4 * k + 4] = quartiles.get((c, 0.25)), quartiles.get((c, 0.75))
    out = {}
    for k, c in enumerate(names):
        n, d, a, b = got[4 * k : 4 * k + 4]
        if n >= least_n and d >= least_distinct and b is not None:
            out[c] = (a - 3 * b, a + 3 * b) if how == "z" else (a - 1.5 * (b - a), b + 1.5 * (b - a))
    return out


def outlier_counts(df: DataFrame, columns: list[str] | None = None, how: str = "z") -> DataFrame:
    """``variable, low, high, n_outliers``; rows are counted, never deleted."""
    bounds = outlier_bounds(df, columns, how)
    schema = "variable string, low double, high double, n_outliers long"
    if not bounds:
        return df.sparkSession.createDataFrame([], schema)
    got = df.agg(*[F.count_if((number(col(c)) < low) | (number(col(c)) > high)).alias(f"a{k}") for k, (c, (low, high)) in enumerate(bounds.items())]).first()
    return df.sparkSession.createDataFrame([(c, float(a), float(b), n) for (c, (a, b)), n in zip(bounds.items(), got, strict=True)], schema)


def run(df: DataFrame, steps: list[Callable[[DataFrame], Step]]) -> tuple[DataFrame, list[str]]:
    """Steps in turn, with their log; the skip flag is dropped at the end."""
    log = []
    for step in steps:
        df, line = step(df)
        log.append(line)
    return df.drop(SKIPPED), log
