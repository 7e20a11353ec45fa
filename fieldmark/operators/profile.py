"""Profiles of a respondent table: measurement kinds, frequencies, descriptives,
cross-tables and reliability."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import dist
from fieldmark.functions.columns import banded_number, col, is_numeric, number
from fieldmark.operators.gram import gram
from fieldmark.operators.ranks import quantile_table

MAX_CATEGORIES, LABEL_LENGTH = 12, 14
# Parts of names that mark amounts.
AMOUNT_NAMES = ("_数值", "数值", "金额", "（元）", "(元)", "支出", "收入", "额度")


@dataclass
class Kind:
    """What one pass over a column shows."""

    name: str
    kind: str
    ordinal: bool
    valid: int
    missing: int
    distinct: int


def kinds(df: DataFrame, columns: list[str] | None = None, max_cat: int = MAX_CATEGORIES, exact: bool = True) -> list[Kind]:
    """``empty``, ``continuous``, ``categorical`` or ``text`` for each column, and whether
    it is an ordinal scale; one aggregation over all of them.

    ``exact`` False counts distinct values approximately, for wide tables at scale.
    """
    columns = columns or df.columns
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs: list[Column] = [F.count("*")]
    for c in columns:
        v, n = col(c), number(col(c))
        if is_numeric(df, c):
            whole = F.coalesce(F.min((n == F.floor(n)).cast("int")), F.lit(0))
            aggs += [F.count(n), distinct(n), F.min(n), F.max(n), whole]
        else:
            aggs += [F.count(v), distinct(v), F.lit(None), F.avg(F.length(v.cast("string"))), F.lit(None)]
    got = df.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs)]).first()
    total, out = got[0], []
    for k, c in enumerate(columns):
        n, d, low, high, whole = got[1 + 5 * k : 6 + 5 * k]
        ordinal = False
        if not n:
            kind = "empty"
        elif is_numeric(df, c):
            banded = (d >= 4 and whole and high - low >= 20) if any(x in c for x in AMOUNT_NAMES) else (d >= 5 and whole and low >= 1000 and high - low >= 1000)
            kind = "continuous" if banded or d > max_cat or not whole else "categorical"
            ordinal = bool(n >= 10 and whole and 3 <= d <= 7 and low >= 0 and high - low <= 8 and high - low == d - 1)
        else:
            kind = "categorical" if d <= max_cat and high <= LABEL_LENGTH else "text"
        out.append(Kind(c, kind, ordinal, n, total - n, d))
    return out


def profile(df: DataFrame, max_cat: int = MAX_CATEGORIES, exact: bool = True) -> DataFrame:
    """``name, kind, n_valid, n_missing, missing_pct, n_unique`` of every column."""
    rows = [(k.name, k.kind, k.valid, k.missing, round(100 * k.missing / (k.valid + k.missing), 1) if k.valid + k.missing else None, k.distinct) for k in kinds(df, None, max_cat, exact)]
    return df.sparkSession.createDataFrame(rows, "name string, kind string, n_valid long, n_missing long, missing_pct double, n_unique long")


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``n_rows, n_complete, n_missing_cells``."""
    columns = columns or df.columns
    missing = sum((col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(missing == 0).alias("n_complete"), F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing_cells"))


def freq_table(df: DataFrame, name: str, top: int = 30) -> DataFrame:
    """``place, value, n, pct, cum_pct``: by count, then value; what is beyond ``top`` in one row."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.orderBy(F.desc("n"), "value").limit(top)
    order = Window.orderBy(F.desc("n"), "value")  # at most ``top`` rows
    head = head.select(F.row_number().over(order).alias("place"), "value", "n", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    all_n, distinct = total
    out = head
    if distinct > top:
        rest = head.agg((F.lit(all_n) - F.sum("n")).alias("n")).select(F.lit(top + 1).alias("place"), F.lit(f"（其余 {distinct - top} 类）").alias("value"), "n", F.lit(all_n).alias("cum"))
        out = head.unionByName(rest)
    return out.select("place", "value", "n", (F.col("n") * 100 / F.lit(all_n)).alias("pct"), (F.col("cum") * 100 / F.lit(all_n)).alias("cum_pct"))


def moments(x: Column) -> dict[str, Column]:
    """n, mean, sd, skewness and kurtosis as samples estimate them (bias-corrected)."""
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    return {
        "n": F.count(x),
        "mean": F.avg(x),
        "sd": F.stddev_samp(x),
        "skew": F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)),
        "kurt": F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
    }


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """``variable, n, mean, sd, median, min, max, skew, kurt``, one row per column (and group).

    All columns are unpivoted into one aggregation. ``exact`` False takes an
    approximate median, which keeps bounded state for each group.
    """
    keys = by or []
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), number(col(c)).alias("x")) for c in columns])).alias("v")
    long = df.select(*[col(k) for k in keys], named).select(*[col(k) for k in keys], "v.variable", "v.x")
    m = moments(F.col("x"))
    sums = {"n": m["n"], "mean": m["mean"], "sd": m["sd"], "min": F.min("x"), "max": F.max("x"), "skew": m["skew"], "kurt": m["kurt"]}
    if exact:
        got = quantile_table(long, [*keys, "variable"], "x", (0.5,), sums).withColumnRenamed("q0", "near")
    else:
        got = long.groupBy(*keys, "variable").agg(*[c.alias(n) for n, c in sums.items()], F.percentile_approx("x", 0.5, 10_000).alias("near"))
    return got.select(*keys, "variable", "n", "mean", "sd", F.col("near").alias("median"), "min", "max", "skew", "kurt")


def cross_table(df: DataFrame, row: str, column: str) -> DataFrame:
    """``row, column, n, row_pct``: cells and margins (null: all of that side)."""
    both = df.where(col(row).isNotNull() & col(column).isNotNull()).select(col(row).cast("string").alias("row"), col(column).cast("string").alias("column"))
    cells = both.cube("row", "column").agg(F.count("*").alias("n"))
    margin = cells.where("column is null").select(F.col("row").alias("_row"), F.col("n").alias("_n"))
    return cells.join(margin, F.col("row").eqNullSafe(F.col("_row"))).select("row", "column", "n", (F.col("n") * 100 / F.col("_n")).alias("row_pct"))


def chi_square(df: DataFrame, row: str, column: str, max_levels: int = MAX_CATEGORIES, yates: bool = True) -> dict:
    """Chi-squared test of independence with Cramer's V and the share of small expectations.

    With one degree of freedom the statistic is corrected for continuity (``yates``).
    """
    both = df.where(col(row).isNotNull() & col(column).isNotNull()).select(col(row).cast("string").alias("a"), col(column).cast("string").alias("b"))
    cells = both.groupBy("a", "b").agg(F.count("*").alias("n")).limit(max_levels**2 + 1).collect()
    a, b = sorted({r["a"] for r in cells}), sorted({r["b"] for r in cells})
    if max(len(a), len(b)) > max_levels:
        raise ValueError(f"more than {max_levels} levels")
    seen = np.zeros((len(a), len(b)))
    for r in cells:
        seen[a.index(r["a"]), b.index(r["b"])] = r["n"]
    n = seen.sum()
    if min(len(a), len(b)) < 2:
        return {"n": int(n), "chi2": None, "df": 0, "p": None, "v": None, "n_expected_lt5": 0, "share_expected_lt5": 0.0}
    expected = np.outer(seen.sum(1), seen.sum(0)) / n
    dof = (len(a) - 1) * (len(b) - 1)
    gap = np.abs(seen - expected)
    if dof == 1 and yates:
        gap -= np.minimum(0.5, gap)
    chi2 = float((gap**2 / expected).sum())
    small = int((expected < 5).sum())
    return {"n": int(n), "chi2": chi2, "df": dof, "p": dist.chi2_sf(chi2, dof), "v": math.sqrt(chi2 / (n * (min(len(a), len(b)) - 1))), "n_expected_lt5": small, "share_expected_lt5": small / expected.size}


def scales(df: DataFrame, min_items: int = 3) -> dict[str, list[str]]:
    """Numbered item columns of one stem whose values are whole numbers from 1 to 7."""
    named = {c: re.fullmatch(r"(.*?)[_\-]?(\d{1,2})", c) for c in df.columns if is_numeric(df, c)}
    items = [c for c, m in named.items() if m]
    if not items:
        return {}
    aggs = []
    for c in items:
        v = number(col(c))
        aggs += [F.count(v), F.min(v), F.max(v), F.coalesce(F.min((v == F.floor(v)).cast("int")), F.lit(0))]
    got = df.agg(*[x.alias(f"a{k}") for k, x in enumerate(aggs)]).first()
    out: dict[str, list[str]] = {}
    for k, c in enumerate(items):
        n, low, high, whole = got[4 * k : 4 * k + 4]
        if n >= 5 and low >= 1 and high <= 7 and whole:
            out.setdefault(named[c][1], []).append(c)
    return {s: v for s, v in out.items() if len(v) >= min_items}


def cronbach_alpha(df: DataFrame, columns: list[str]) -> dict | None:
    """Alpha over complete rows, and alpha without each item, from one covariance matrix."""
    g = gram(df, {c: number(col(c)) for c in columns})
    if len(columns) < 2 or g.n < 3:
        return None

    def alpha(at: list[int]) -> float | None:
        c = g.cov()[np.ix_(at, at)]
        k, total = len(at), c.sum()
        return float(k / (k - 1) * (1 - np.trace(c) / total)) if k > 1 and total > 0 else None

    at = list(range(len(columns)))
    whole = alpha(at)
    if whole is None:
        return None
    return {"n": int(g.n), "k": len(columns), "alpha": whole, "if_deleted": {c: alpha([j for j in at if j != k]) for k, c in enumerate(columns)}}


def banded_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Label columns that read as numbers throughout: 2 to 8 labels, each convertible, not all plain."""
    if not columns:
        return []
    aggs = []
    for c in columns:
        s = F.trim(col(c).cast("string"))
        filled = F.when(s != "", s)
        aggs += [F.count_distinct(filled), F.count(filled), F.count(F.when(filled.isNotNull(), banded_number(filled))), F.count(F.when(filled.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), 1))]
    got = df.agg(*[x.alias(f"a{k}") for k, x in enumerate(aggs)]).first()
    return [c for k, c in enumerate(columns) if 2 <= got[4 * k] <= 8 and got[4 * k + 1] == got[4 * k + 2] and got[4 * k + 3] < got[4 * k + 1]]


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75), exact: bool = True) -> DataFrame:
    """``variable, q, value``: linearly interpolated quantiles, or approximate ones with bounded state."""
    if exact:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), number(col(c)).alias("x")) for c in columns])).alias("v")
        wide = quantile_table(df.select(each).select("v.*"), ["variable"], "x", at)
        return wide.unpivot("variable", [f"q{k}" for k in range(len(at))], "k", "value").select("variable", F.element_at(F.array(*map(F.lit, at)), F.substring("k", 2, 9).cast("int") + 1).alias("q"), "value")
    wide = df.agg(*[F.percentile_approx(number(col(c)), list(at), 10_000).alias(f"q{k}") for k, c in enumerate(columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"q{k}").alias("v")) for k, c in enumerate(columns)])).alias("r")
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), F.col("r.v").alias("value"))).alias("p")
    return wide.select(each).select("r.variable", pairs).select("variable", F.col("p.q").alias("q"), F.col("p.value").alias("value"))
