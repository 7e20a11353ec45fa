"""Average ranks without a single-task sort: from a table of distinct values and counts.

Counts of distinct values are taken first, so the ordered part shrinks with ties; the
running count comes from a range partitioning, sums inside each partition plus the
sums of those before it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import dist
from fieldmark.functions.columns import col
from fieldmark.sources.tables import written


#: Rows whose running sums one task takes.
FEW = 100_000


def running(df: DataFrame, order: list[str], amounts: dict[str, str]) -> DataFrame:
    """``df`` plus running sums, by name, over a global order; each row included.

    The rows are written first. Few ones, which a count of the written rows tells, are summed
    in one task; more are dealt to ranges, and written with the number of their range, since a
    second execution could cut the ranges elsewhere. Both ways give the same sums.
    """
    kept = written(df)
    if kept.count() <= FEW:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return kept.select("*", *[F.sum(c).over(upto).alias(n) for n, c in amounts.items()])
    dealt = written(kept.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.select("*", *[F.sum(c).over(inside).alias(n) for n, c in amounts.items()])
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in amounts.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in amounts])
    # one row per partition
    return dealt.join(F.broadcast(starts), "_part").select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in amounts])


#: Size of a sketch; its rank error, of which brackets take four: far beyond any that is met.
SKETCH = 4000
RANK_ERROR = 2.296 / SKETCH**0.9021
#: Values of a group that are all counted, without a bracket.
FULL = 4 * SKETCH


def quantile_table(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], more: dict[str, Column] | None = None) -> DataFrame:
    """``keys``, the aggregates of ``more`` and ``q0, q1, ...``: exact quantiles of a column in each
    group, linearly interpolated; null where a group has no value.

    Two scans. The first makes a mergeable sketch of each group, beside ``more``, which brackets each
    quantile. The second counts what lies below each bracket and the values inside it, of
    which there are a small share of all; the quantile is read from their running counts.
    No state holds a group's values. A bracket that missed its quantile would raise.
    """
    more = more or {}
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    x = col(value).cast("double")
    summed = df.groupBy(*[col(k).alias(n) for k, n in names.items()]).agg(F.count(x).alias("_n"), F.kll_sketch_agg_double(x, F.lit(SKETCH)).alias("_s"), *[c.alias(f"_m{i}") for i, c in enumerate(more.values())])
    first = written(summed)  # a row for each group
    some = F.col("_n") > 0
    margin = 4 * RANK_ERROR
    ends = []
    for k, q in enumerate(at):
        place = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)
        # one place is less than the margin in a group beyond FULL; a smaller group is bracketed whole
        inside = [F.kll_sketch_get_quantile_double("_s", F.lit(min(1.0, max(0.0, q + e)))) for e in (-margin, margin)]
        bounds = [F.when(F.col("_n") > FULL, b).otherwise(F.lit(end)) for b, end in zip(inside, (-math.inf, math.inf), strict=True)]
        ends.append(F.struct(F.lit(k).alias("k"), bounds[0].alias("lo"), bounds[1].alias("hi"), low.alias("low"), high.alias("high"), (place % 1).alias("part")))
    brackets = first.where(some).select(*names.values(), F.array(*ends).alias("ends"))
    inner = df.where(x.isNotNull()).select(*[col(k).alias(f"_j{i}") for i, k in enumerate(keys)], x.alias("_x"))
    same = [F.col(f"_j{i}").eqNullSafe(F.col(n)) for i, n in enumerate(names.values())]
    met = inner.join(brackets, reduce(lambda a, b: a & b, same)) if same else inner.join(F.broadcast(brackets))
    near = met.select(*names.values(), "_x", F.explode("ends").alias("e")).where("_x <= e.hi")
    counts = near.groupBy(*names.values(), "e", F.when(F.col("_x") >= F.col("e.lo"), F.col("_x")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*names.values(), "e.k").orderBy(F.col("v").asc_nulls_first()))
    placed = counts.withColumn("upto", upto)
    at_end = {side: F.max(F.when((F.col(f"e.{side}") < F.col("upto")) & (F.col(f"e.{side}") >= F.col("upto") - F.col("c")), F.col("v"))) for side in ("low", "high")}
    found = placed.groupBy(*names.values(), "e.k").agg(*[c.alias(side) for side, c in at_end.items()], F.first("e.part").alias("part"))
    missed = F.when(F.col("low").isNull() | F.col("high").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    q = F.coalesce(missed, F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part")))
    wide = found.select(*[F.col(n).alias(f"_j{i}") for i, n in enumerate(names.values())], "k", q.alias("q")).groupBy(*[f"_j{i}" for i in range(len(keys))]).agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(at))])
    out = first.join(wide, reduce(lambda a, b: a & b, same), "left") if same else first.join(F.broadcast(wide), how="left")
    return out.select(*[F.col(n).alias(k) for k, n in names.items()], *[F.col(f"_m{i}").alias(k) for i, k in enumerate(more)], *[f"q{k}" for k in range(len(at))])


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """``value, n, rank``: each distinct value with its count and average rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return running(counts, [value], {"upto": "n"}).select(value, "n", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def group_rank_sums(df: DataFrame, group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``(group, n, rank_sum, rank_mean)`` and ``(n, ties)`` with ties = sum of t^3 - t."""
    cells = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    totals = cells.groupBy(value).agg(F.sum("k").alias("n"))
    ranked = running(totals, [value], {"upto": "n"}).select(value, "n", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    sums = cells.join(ranked.select(value, "rank"), value).groupBy(group).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("rank_sum"))
    n = F.col("n").cast("double")
    return sums.withColumn("rank_mean", F.col("rank_sum") / F.col("n")), totals.agg(F.sum("n").alias("n"), F.sum(n * n * n - n).alias("ties"))


def with_ranks(df: DataFrame, values: list[str]) -> DataFrame:
    """``df`` plus ``rank_<value>`` for each of the columns."""
    for v in values:
        df = df.join(value_ranks(df, v).select(v, F.col("rank").alias(f"rank_{v}")), v, "left")
    return df


def mann_whitney(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> dict:
    """U of the first group in string order, tie-corrected normal p with continuity
    correction (exact where both groups have at most 8 rows and nothing is tied), and the
    rank-biserial correlation 1 - 2U/(n1 n2): positive where the first group is lower."""
    if df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group).distinct().limit(3).count() != 2:
        raise ValueError("two groups are needed")
    sums, total = group_rank_sums(df, group, value)
    rows = sorted(sums.collect(), key=lambda r: str(r[group]))
    if len(rows) != 2:
        raise ValueError("two groups are needed")
    (n1, r1), n2 = (rows[0]["n"], rows[0]["rank_sum"]), rows[1]["n"]
    _, ties = total.first()
    return {"levels": [str(r[group]) for r in rows]} | u_test(n1, n2, r1 - n1 * (n1 + 1) / 2, ties, alpha)


def u_test(n1: int, n2: int, u: float, ties: float, alpha: float = 0.05) -> dict:
    """What follows from U of the first of two groups and the sum of t^3 - t over ties."""
    n, mean = n1 + n2, n1 * n2 / 2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))) if n > 1 else 0.0
    if max(n1, n2) <= 8 and not ties:
        p = min(1.0, 2 * _u_cdf(int(min(u, n1 * n2 - u)), n1, n2))
    else:
        z = max(0.0, abs(u - mean) - 0.5) / math.sqrt(var) if var > 0 else 0.0
        p = 2 * dist.norm_cdf(-z)
    rb = 1 - 2 * u / (n1 * n2)
    half = dist.norm_ppf(1 - alpha / 2) * math.sqrt((n1 + n2 + 1) / (3 * n1 * n2))
    return {"n1": n1, "n2": n2, "u": u, "p": p, "rank_biserial": rb, "rank_biserial_low": max(-1.0, rb - half), "rank_biserial_high": min(1.0, rb + half)}


def pair_ranks(df: DataFrame, group: str, value: str, levels: list[str]) -> dict[tuple[int, int], tuple[float, float]]:
    """U of the first group and the sum of t^3 - t over ties, for each pair of ``levels`` by their places.

    One row for each distinct value holds every level's count there and below; each pair reads
    its two, so all pairs take one ordering and one aggregation.
    """
    k = len(levels)
    rows = df.where(col(value).isNotNull()).groupBy(col(value).alias("v")).agg(*[F.count_if(col(group) == x).alias(f"n{i}") for i, x in enumerate(levels)])
    placed = running(rows, ["v"], {f"c{i}": f"n{i}" for i in range(k)})
    wide = placed.select(F.array(*[f"n{i}" for i in range(k)]).alias("n"), F.array(*[f"c{i}" for i in range(k)]).alias("c"))
    every = F.array(*map(F.lit, range(k)))

    def of(i: Column, j: Column) -> Column:
        ni, nj, cj = (F.get(F.col(a), b) for a, b in (("n", i), ("n", j), ("c", j)))
        t = (ni + nj).cast("double")
        counted = (nj > 0) & (j < i)  # the other level of the pair speaks for both
        return F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), F.when(i < j, ni * (cj - nj / 2)).otherwise(0.0).alias("u"), F.when(counted, 0.0).otherwise(t * t * t - t).alias("ties"))

    present = F.filter(every, lambda i: F.get(F.col("n"), i) > 0)
    found = F.flatten(F.transform(present, lambda i: F.filter(F.transform(every, lambda j: of(i, j)), lambda x: (x["i"] < x["j"]) & ((x["u"] > 0) | (x["ties"] > 0)))))
    got = wide.select(F.explode(found).alias("x")).groupBy("x.i", "x.j").agg(F.sum("x.u").alias("u"), F.sum("x.ties").alias("ties")).collect()
    return {(r["i"], r["j"]): (r["u"], r["ties"]) for r in got}


def _u_cdf(u: int, n1: int, n2: int) -> float:
    """P(U <= u) by counting arrangements."""
    ways = [1] + [0] * (n1 * n2)
    for k in range(1, n1 + 1):
        for x in range(n1 * n2, n2 + k - 1, -1):
            ways[x] -= ways[x - n2 - k]
        for x in range(k, n1 * n2 + 1):
            ways[x] += ways[x - k]
    return sum(ways[: u + 1]) / math.comb(n1 + n2, n1)


def kruskal(df: DataFrame, group: str, value: str, most: int = 200) -> dict:
    """Tie-corrected H, p and epsilon squared (H - k + 1)/(n - k); more than ``most`` groups raise."""
    sums, total = group_rank_sums(df, group, value)
    rows, (n, ties) = sums.limit(most + 1).collect(), total.first()
    k = len(rows)
    if k > most:
        raise ValueError(f"{group} has more than {most} groups")
    h = 12 / (n * (n + 1)) * sum(r["rank_sum"] ** 2 / r["n"] for r in rows) - 3 * (n + 1)
    fix = 1 - ties / (n**3 - n)
    h = h / fix if fix > 0 else 0.0
    return {"k": k, "n": n, "h": h, "df": k - 1, "p": dist.chi2_sf(h, k - 1), "epsilon2": (h - k + 1) / (n - k)}


def kendall(df: DataFrame, x: str, y: str) -> dict:
    """Tau-b from the table of distinct pairs, without comparing all of them.

    Two values of x part at the highest bit in which their codes (places among the
    distinct values) differ. For each bit, cells that share the higher bits are
    ordered by y, and running counts of those with the bit unset give the concordant and
    discordant pairs: one distributed sort for each bit.
    """
    cells = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n"))
    codes = running(cells.select("x").distinct().withColumn("one", F.lit(1).cast("long")), ["x"], {"code": "one"}).select("x", "code")
    cells = cells.join(codes, "x").select("code", "y", "n")
    top, totals = cells.agg(F.max("code"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tied = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    tx = cells.groupBy("code").agg(F.sum("n").alias("n")).agg(tied).first()[0] or 0.0
    ty = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(tied).first()[0] or 0.0
    s = 0.0
    for k in range(int(top or 0).bit_length()):
        unset = F.col("code").bitwiseAND(1 << k) == 0
        part = cells.groupBy(F.shiftright("code", k + 1).alias("high"), "y").agg(F.sum(F.when(unset, F.col("n")).otherwise(0)).alias("low_n"), F.sum(F.when(~unset, F.col("n")).otherwise(0)).alias("high_n"))
        starts = running(part.groupBy("high").agg(F.sum("low_n").alias("all")), ["high"], {"upto": "all"})
        part = running(part, ["high", "y"], {"run": "low_n"}).join(starts, "high")
        below = F.col("run") - F.col("low_n") - (F.col("upto") - F.col("all"))
        above = F.col("upto") - F.col("run")
        s += part.agg(F.sum(F.col("high_n") * (below - above).cast("double"))).first()[0] or 0.0
    pairs = totals * (totals - 1) / 2
    base = math.sqrt((pairs - tx) * (pairs - ty))
    tau = s / base if base else float("nan")
    var = 2 * (2 * totals + 5) / (9 * totals * (totals - 1)) if totals > 1 else float("nan")
    z = abs(tau) / math.sqrt(var) if totals > 1 and not math.isnan(tau) else float("nan")
    return {"n": int(totals), "tau": tau, "p": 2 * dist.norm_cdf(-z) if z == z else float("nan")}
