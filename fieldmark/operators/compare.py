"""Between-group and within-subject comparisons from distributed sufficient statistics.

Groups are taken in string order (a table has no first row); signs follow that order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import dist
from fieldmark.functions.columns import col, number
from fieldmark.operators.ranks import kruskal, mann_whitney, pair_ranks, quantile_table, running, u_test
from fieldmark.plans.methods import override_compare, pick_compare, pick_within

#: Rows up to which normality is tested by Shapiro-Wilk; beyond, by the moments.
SHAPIRO_ROWS, SEED = 5000, 20260926


@dataclass
class Group:
    level: str
    n: int
    mean: float
    sd: float
    median: float
    skew: float | None
    kurt: float | None


def _long(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.select(col(group).cast("string").alias("g"), number(col(value)).alias("x")).dropna()


def groups(df: DataFrame, group: str, value: str, most: int = 200) -> list[Group]:
    """n, mean, sd, median and population moments of each group."""
    long = _long(df, group, value)
    sums = {"n": F.count("*"), "mean": F.avg("x"), "sd": F.stddev_samp("x"), "skew": F.skewness("x"), "kurt": F.kurtosis("x")}
    got = quantile_table(long, ["g"], "x", (0.5,), sums).select("g", "n", "mean", "sd", "q0", "skew", "kurt").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{group} has more than {most} groups")
    return sorted((Group(*r) for r in got), key=lambda g: g.level)


def group_table(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """``level, n, mean, ci_low, ci_high, sd, median`` of each group."""
    rows = []
    for g in groups(df, group, value):
        half = dist.t_ppf(1 - alpha / 2, g.n - 1) * g.sd / math.sqrt(g.n) if g.n > 1 else None
        rows.append((g.level, g.n, g.mean, g.mean - half if half is not None else None, g.mean + half if half is not None else None, g.sd, g.median))
    return df.sparkSession.createDataFrame(rows, "level string, n long, mean double, ci_low double, ci_high double, sd double, median double")


def normal(values: DataFrame, alpha: float = 0.05) -> bool | None:
    """Whether the one column looks normal; None below four values.

    Up to ``SHAPIRO_ROWS`` values come to the driver, which is the test's own range.
    """
    n, skew, kurt = values.agg(F.count("*"), F.skewness(values.columns[0]), F.kurtosis(values.columns[0])).first()
    if n < 4:
        return None
    if n <= SHAPIRO_ROWS:
        return dist.shapiro(np.array([r[0] for r in values.collect()]))[1] > alpha
    return bool(skew is not None and abs(skew) < 1 and abs(kurt) < 2)


def one_way(n: list[int], mean: list[float], var: list[float]) -> dict:
    """F, p and eta squared from group sizes, means and variances."""
    total, k = sum(n), len(n)
    grand = sum(a * b for a, b in zip(n, mean, strict=True)) / total
    between = sum(a * (m - grand) ** 2 for a, m in zip(n, mean, strict=True))
    within = sum((a - 1) * v for a, v in zip(n, var, strict=True))
    d1, d2 = k - 1, total - k
    f = between / d1 / (within / d2) if within > 0 and d2 > 0 else math.nan
    return {"f": f, "df1": d1, "df2": d2, "p": dist.f_sf(f, d1, d2) if f == f else None, "eta2": between / (between + within) if between + within > 0 else None}


def eta2_interval(eta2: float, d1: int, d2: int, alpha: float = 0.05) -> tuple[float, float]:
    """Interval of eta squared by inverting the non-central F."""
    f = eta2 / d1 / ((1 - eta2) / d2)
    ends = [dist.ncf_nc(f, d1, d2, p) for p in (1 - alpha / 2, alpha / 2)]
    return tuple(sorted(x / (x + d1 + d2 + 1) for x in ends))


def welch_anova(gs: list[Group]) -> dict:
    """Welch's one-way test, for unequal variances."""
    k, w = len(gs), [g.n / g.sd**2 for g in gs]
    total = sum(w)
    grand = sum(a * g.mean for a, g in zip(w, gs, strict=True)) / total
    lam = sum((1 - a / total) ** 2 / (g.n - 1) for a, g in zip(w, gs, strict=True))
    f = sum(a * (g.mean - grand) ** 2 for a, g in zip(w, gs, strict=True)) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam)
    d2 = (k * k - 1) / (3 * lam)
    return {"f": f, "df1": k - 1, "df2": d2, "p": dist.f_sf(f, k - 1, d2)}


def levene(df: DataFrame, group: str, value: str, most: int = 200) -> dict:
    """Levene's test about the group medians (Brown-Forsythe); more than ``most`` groups raise."""
    long = _long(df, group, value)
    middle = quantile_table(long, ["g"], "x", (0.5,)).withColumnRenamed("q0", "m")
    away = long.join(middle, "g").select("g", F.abs(F.col("x") - F.col("m")).alias("d"))
    got = away.groupBy("g").agg(F.count("*"), F.avg("d"), F.coalesce(F.var_samp("d"), F.lit(0.0))).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{group} has more than {most} groups")
    out = one_way([r[1] for r in got], [r[2] for r in got], [r[3] for r in got])
    return {"f": out["f"], "df1": out["df1"], "df2": out["df2"], "p": out["p"]}


def t_test(a: Group, b: Group, equal_var: bool, alpha: float = 0.05) -> dict:
    """Student's or Welch's t with its own degrees of freedom, Welch's interval of the
    difference, and Cohen's d with its interval."""
    va, vb = a.sd**2 / a.n, b.sd**2 / b.n
    welch_df = (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    pooled = ((a.n - 1) * a.sd**2 + (b.n - 1) * b.sd**2) / (a.n + b.n - 2)
    se, df = (math.sqrt(pooled * (1 / a.n + 1 / b.n)), a.n + b.n - 2) if equal_var else (math.sqrt(va + vb), welch_df)
    diff = a.mean - b.mean
    t, half = diff / se, dist.t_ppf(1 - alpha / 2, welch_df) * math.sqrt(va + vb)
    d = diff / math.sqrt(pooled)
    spread = dist.norm_ppf(1 - alpha / 2) * math.sqrt(1 / a.n + 1 / b.n + d * d / (2 * (a.n + b.n)))
    return {"t": t, "df": df, "p": dist.t_sf2(t, df), "diff": diff, "diff_low": diff - half, "diff_high": diff + half, "d": d, "d_low": d - spread, "d_high": d + spread}


def post_hoc(df: DataFrame, group: str, value: str, parametric: bool, alpha: float = 0.05) -> DataFrame:
    """Every pair of groups: Tukey's HSD, or rank tests with Bonferroni's correction; both with the
    rank-biserial correlation of the pair and its interval. Ranks of all pairs are taken together."""
    gs = groups(df, group, value)
    pairs = list(combinations(range(len(gs)), 2))
    ranks = pair_ranks(_long(df, group, value), "g", "x", [g.level for g in gs])
    rows = []
    total = sum(g.n for g in gs)
    mse = sum((g.n - 1) * g.sd**2 for g in gs) / (total - len(gs)) if parametric else None
    for i, j in pairs:
        a, b = gs[i], gs[j]
        got = u_test(a.n, b.n, *ranks.get((i, j), (0.0, 0.0)), alpha)
        if parametric:
            q = abs(a.mean - b.mean) / math.sqrt(mse / 2 * (1 / a.n + 1 / b.n))
            p = dist.tukey_sf(q, len(gs), total - len(gs))
            row = (a.level, b.level, "tukey", a.mean - b.mean, q, p, p < alpha)
        else:
            p = min(1.0, got["p"] * len(pairs))
            row = (a.level, b.level, "rank test", got["rank_biserial"], got["u"], p, p < alpha)
        rows.append((*row, *(got[f"rank_biserial{x}"] for x in ("", "_low", "_high"))))
    schema = "level_a string, level_b string, method string, effect double, statistic double, p double, significant boolean, rank_biserial double, rank_biserial_low double, rank_biserial_high double"
    return df.sparkSession.createDataFrame(rows, schema)


def compare(df: DataFrame, group: str, value: str, alpha: float = 0.05, policy: str = "nonparam", method: str | None = None) -> dict:
    """The chosen test of a value between groups, with effect size and reasons.

    ``policy``: what to do where normality fails: ``nonparam``, ``keep`` or ``stop``.
    """
    gs = groups(df, group, value)
    if len(gs) < 2:
        return {"method": None, "reason": "fewer than two groups"}
    long = _long(df, group, value)
    checks = [normal(long.where(F.col("g") == g.level).select("x"), alpha) for g in gs]
    spread = levene(df, group, value)
    equal = spread["p"] is None or spread["p"] > alpha
    fine = all(c is not False for c in checks)
    if not fine and policy == "stop":
        return {"method": None, "reason": "a group is not normal", "normal": checks, "levene": spread}
    chosen = override_compare(len(gs), method) or pick_compare(len(gs), fine or policy == "keep", equal)
    out = {"method": chosen, "normal": checks, "levene": spread, "groups": gs}
    if chosen in ("t", "welch"):
        out |= t_test(gs[0], gs[1], chosen == "t", alpha)
    elif chosen == "mannwhitney":
        out |= mann_whitney(long, "g", "x", alpha)
    elif chosen == "kruskal":
        out |= kruskal(long, "g", "x")
    else:
        out |= one_way([g.n for g in gs], [g.mean for g in gs], [g.sd**2 for g in gs])
        if out["eta2"] is not None and 0 < out["eta2"] < 1:
            out["eta2_low"], out["eta2_high"] = eta2_interval(out["eta2"], out["df1"], out["df2"], alpha)
        if chosen == "anova_welch":
            out |= welch_anova(gs)
    if len(gs) > 2 and out["p"] is not None and out["p"] < alpha:
        out["post_hoc"] = post_hoc(df, group, value, chosen in ("anova", "anova_welch"), alpha)
    return out


def differences(df: DataFrame, first: str, second: str) -> DataFrame:
    """``d``: second minus first over complete pairs."""
    return df.select((number(col(second)) - number(col(first))).alias("d")).dropna()


def _mean_interval(n: int, mean: float, sd: float, alpha: float) -> tuple[float, float]:
    half = dist.t_ppf(1 - alpha / 2, n - 1) * sd / math.sqrt(n)
    return mean - half, mean + half


def one_sample_t(df: DataFrame, value: str, mu: float = 0.0, alpha: float = 0.05) -> dict:
    n, mean, sd = df.select(number(col(value)).alias("x")).agg(F.count("x"), F.avg("x"), F.stddev_samp("x")).first()
    if n < 2:
        return {"n": n, "t": None, "p": None}
    if not sd:
        return {"n": n, "mean": mean, "sd": 0.0, "degenerate": True, "t": None, "p": None}
    t, (low, high) = (mean - mu) / (sd / math.sqrt(n)), _mean_interval(n, mean, sd, alpha)
    d = (mean - mu) / sd
    half = dist.norm_ppf(1 - alpha / 2) * math.sqrt(1 / n + d * d / (2 * n))
    return {"n": n, "mean": mean, "sd": sd, "t": t, "df": n - 1, "p": dist.t_sf2(t, n - 1), "ci_low": low, "ci_high": high, "dz": d, "dz_low": d - half, "dz_high": d + half, "degenerate": False}


def wilcoxon(diffs: DataFrame, alpha: float = 0.05) -> dict:
    """Signed-rank test of the column ``d``; zeros are dropped and counted.

    Exact where at most 25 differences are left and none are tied.
    """
    cells = diffs.where("d is not null").groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("k"))
    # zeros stand first, so a rank among the others is the place without them
    place = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    some, k = F.col("m") > 0, F.col("n").cast("double")
    n, zeros, above, ranked, ties = running(cells, ["m"], {"upto": "n"}).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0)),
        F.coalesce(F.sum(F.col("k") * place), F.lit(0.0)), F.coalesce(F.sum(F.when(some, k * k * k - k)), F.lit(0.0)),
    ).first()
    plus = ranked - zeros * above
    use = n - zeros
    if not use:
        return {"n_pair": n, "n_zero": zeros, "n_use": 0, "w": None, "p": None, "rank_biserial": None}
    total = use * (use + 1) / 2
    minus = total - plus
    w = min(plus, minus)
    if use <= 25 and not ties:
        ways = [1] + [0] * int(total)
        for r in range(1, use + 1):
            for x in range(int(total), r - 1, -1):
                ways[x] += ways[x - r]
        p, exact = min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**use), True
    else:
        sd = math.sqrt(use * (use + 1) * (2 * use + 1) / 24 - ties / 48)
        p, exact = 2 * dist.norm_cdf((w - total / 2) / sd), False
    return {"n_pair": n, "n_zero": zeros, "n_use": use, "w": w, "w_plus": plus, "w_minus": minus, "p": min(1.0, p), "exact": exact, "rank_biserial": (plus - minus) / total}


def bootstrap_median(diffs: DataFrame, alpha: float = 0.05, replicates: int = 2000, seed: int = SEED) -> tuple[float, float] | None:
    """Percentile interval of the median of resamples with replacement.

    The middle places of a sorted resample are places of the sorted rows whose parts of n
    follow beta distributions, so each replicate draws its places and no row is copied. What
    is read are the values between the least and the greatest place, a few times the square
    root of n.
    """
    counts = diffs.where("d is not null").groupBy("d").agg(F.count("*").alias("n"))
    placed = running(counts, ["d"], {"upto": "n"})
    n = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n < 5:
        return None
    rng = np.random.default_rng(seed)
    low = rng.beta((n + 1) // 2, n // 2 + 1, replicates)
    # the next of the n // 2 sorted parts that lie above the first
    high = low if n % 2 else low + (1 - low) * (1 - rng.random(replicates) ** (2 / n))
    at = np.minimum(np.floor(np.stack([low, high]) * n), n - 1)
    near = placed.where((F.col("upto") > int(at.min())) & (F.col("upto") - F.col("n") <= int(at.max()))).orderBy("upto").select("d", "upto").toPandas()
    medians = near["d"].to_numpy()[np.searchsorted(near["upto"].to_numpy(), at, side="right")].mean(axis=0)
    low, high = np.percentile(medians, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def within(df: DataFrame, first: str, second: str, alpha: float = 0.05) -> dict:
    """Paired comparison: paired t where the differences are normal, else signed ranks."""
    d = differences(df, first, second)
    n, zeros = d.agg(F.count("*"), F.count_if(F.col("d") == 0)).first()
    method = pick_within(True, normal(d, alpha) is not False, zeros / n if n else None)["method"]
    out = {"method": method} | (one_sample_t(d, "d", 0.0, alpha) if method == "paired_t" else wilcoxon(d, alpha))
    if method == "wilcoxon":
        out["median_ci"] = bootstrap_median(d, alpha)
    return out


def histogram(values: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """``bin, low, high, n`` of equal-width bins; 6 to 20 by the number of rows."""
    low, high, n = values.agg(F.min(name), F.max(name), F.count(name)).first()
    bins = bins or min(20, max(6, n // 8))
    width = (high - low) / bins if n and high > low else 1.0
    at = F.least(F.floor((col(name) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return values.where(col(name).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whisker ends and outlier counts of each group, ready to draw."""
    long = _long(df, group, value)
    q = quantile_table(long, ["g"], "x", (0.25, 0.5, 0.75)).toDF("g", "q1", "median", "q3")
    inside: Column = F.col("x").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return long.join(q, "g").groupBy(F.col("g").alias("level"), "q1", "median", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count_if(~inside).alias("n_outside"))
