"""Survey weights: checks, weighted estimates, and what weighting changes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import dist
from fieldmark.functions.columns import col, number
from fieldmark.operators.gram import gram

#: Share of all weight from which one row counts as extreme.
EXTREME_SHARE = 0.05


def check(df: DataFrame, weight: str) -> dict:
    """Counts of missing, zero and negative weights, Kish's effective n and design effect."""
    w = number(col(weight))
    good = F.when(w > 0, w)
    missing, zero, negative, n, s, s2, low, high = df.agg(F.count_if(w.isNull()), F.count_if(w == 0), F.count_if(w < 0), F.count(good), F.sum(good), F.sum(good * good), F.min(good), F.max(good)).first()
    n_eff = s * s / s2 if n else None
    return {"missing": missing, "zero": zero, "negative": negative, "positive": n, "min": low, "max": high, "ratio": high / low if n else None, "max_share": high / s if n else None, "n_eff": n_eff, "deff": n / n_eff if n else None, "extreme": bool(n and high / s > EXTREME_SHARE)}


def estimates(df: DataFrame, value: str, weight: str, group: str | None = None) -> DataFrame:
    """``n, mean, var, n_eff, se, df`` (by group): one aggregation of weighted sums about the mean."""
    keys = ["g"] if group else []
    rows = df.select(number(col(value)).alias("x"), number(col(weight)).alias("w"), *([col(group).cast("string").alias("g")] if group else [])).dropna().where("w > 0")
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") ** 2).alias("sw2"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"))
    var = (F.col("sxx") - F.col("sw") * F.col("mean") ** 2) / F.when(F.col("sw") > F.col("sw2") / F.col("sw"), F.col("sw") - F.col("sw2") / F.col("sw"))
    out = first.withColumn("var", F.greatest(var, F.lit(0.0))).withColumn("n_eff", F.col("sw") ** 2 / F.col("sw2"))
    return out.select(*keys, "n", "mean", "var", "n_eff", F.sqrt(F.col("var") / F.col("n_eff")).alias("se"), F.greatest(F.col("n_eff") - 1, F.lit(1.0)).alias("df"))


def weighted_mean(df: DataFrame, value: str, weight: str, alpha: float = 0.05) -> dict:
    r = estimates(df, value, weight).first().asDict()
    if not r["n"] or r["se"] is None:
        return r
    half = dist.t_ppf(1 - alpha / 2, r["df"]) * r["se"]
    return r | {"ci_low": r["mean"] - half, "ci_high": r["mean"] + half}


def weighted_corr(df: DataFrame, x: str, y: str, weight: str) -> dict:
    w = number(col(weight))
    n_eff, n = df.where(w > 0).select(number(col(x)).alias("x"), number(col(y)).alias("y"), w.alias("w")).dropna().agg(F.sum("w") ** 2 / F.sum(F.col("w") ** 2), F.count("*")).first()
    r = float(gram(df.where(w > 0), {"x": number(col(x)), "y": number(col(y))}, w).corr()[0, 1])
    dof = n_eff - 2
    return {"n": n, "n_eff": n_eff, "r": r, "df": dof, "p": dist.t_sf2(r * math.sqrt(dof / (1 - r * r)), dof) if abs(r) < 1 and dof > 0 else None}


def weighted_diff(df: DataFrame, value: str, group: str, weight: str, alpha: float = 0.05) -> dict:
    """Second group minus the first, in string order, with the smaller effective n's freedom."""
    a, b = sorted(estimates(df, value, weight, group).collect(), key=lambda r: r["g"])
    diff, se, dof = b["mean"] - a["mean"], math.sqrt(a["se"] ** 2 + b["se"] ** 2), max(min(a["n_eff"], b["n_eff"]) - 1, 1.0)
    t, half = (diff / se if se else math.nan), dist.t_ppf(1 - alpha / 2, dof) * se
    return {"levels": [a["g"], b["g"]], "diff": diff, "se": se, "t": t, "df": dof, "p": dist.t_sf2(t, dof) if se else None, "ci_low": diff - half, "ci_high": diff + half}


def compare_weighted(df: DataFrame, value: str, weight: str) -> dict:
    """The unweighted and the weighted mean side by side, over the same rows."""
    rows = df.where((number(col(weight)) > 0) & number(col(value)).isNotNull())
    plain = rows.agg(F.avg(number(col(value))), F.stddev_samp(number(col(value))) / F.sqrt(F.count("*"))).first()
    w = weighted_mean(rows, value, weight)
    return {"mean": plain[0], "se": plain[1], "weighted_mean": w["mean"], "weighted_se": w["se"], "shift": w["mean"] - plain[0], "se_ratio": w["se"] / plain[1] if plain[1] else None, "deff": w["n"] / w["n_eff"]}
