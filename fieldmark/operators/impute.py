"""Multiple imputation by chained equations, and pooling.

A sweep regresses each incomplete column on all others from cross products and draws
around the prediction. Noise is keyed by row, set, sweep and column, so results do not
depend on how rows lie.

A filled cell is a linear function of its row's values and noise, the same one for all rows that
lack the same columns. So the cross products of values and noise, gathered once for each such
pattern and set, give every regression of every sweep, and no table is written. Where
patterns are too many for that, sweeps go over the rows; every few are written out, so plans stay short.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import dist
from fieldmark.functions.columns import col, number_of
from fieldmark.operators.gram import Gram, grams
from fieldmark.operators.regress import solve
from fieldmark.sources.tables import written

SETS, SWEEPS, SEED, LEAST = 5, 10, 20260926, 5
#: Numbers in the matrices of all patterns and sets, at most (8 MB on the driver).
MOST = 1_000_000


def uniform(*keys: Column | str | int) -> Column:
    """A keyed number strictly between 0 and 1."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return ((F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") + 0.5) / float(1 << 53)


def normal(*keys: Column | str | int) -> Column:
    """A keyed standard normal number (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(*keys, "a"))) * F.cos(2 * math.pi * uniform(*keys, "b"))


def mice(df: DataFrame, row_id: str, columns: list[str], sets: int = SETS, sweeps: int = SWEEPS, seed: int = SEED, skip: Column | None = None) -> DataFrame:
    """``_set`` 1..sets times the rows with the numeric columns completed.

    Starts from means. Columns with fewer than ``LEAST`` values stay as they are; cells
    where ``skip`` holds are structural and stay null in the result.
    """
    base = df.select(*[col(c) for c in df.columns if c not in columns], *[number_of(df, c).alias(c) for c in columns])
    seen = base.agg(*[F.count(col(c)) for c in columns], *[F.avg(col(c)) for c in columns], F.count("*")).first()
    k, total = len(columns), seen[-1]
    use = [c for j, c in enumerate(columns) if seen[j] >= LEAST]
    holes = [c for j, c in enumerate(columns) if c in use and seen[j] < total]
    mean = {c: seen[k + j] for j, c in enumerate(columns)}
    skip = F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)
    start = base.withColumn("_skip", skip)
    for c in use:
        start = start.withColumn(f"_m_{c}", col(c).isNull()).withColumn(c, F.coalesce(col(c), F.lit(mean[c])))
    size = 1 + len(use) + len(holes) * sweeps
    if holes and sweeps and sets * 2 ** len(holes) * size**2 <= MOST:
        done = _by_pattern(start, row_id, use, holes, mean, sets, sweeps, seed)
        return done.select("_set", *[(F.when(F.col("_skip") & F.col(f"_m_{c}"), None).otherwise(col(c)) if c in holes else col(c)).alias(c) for c in df.columns])
    rows = written(start.withColumn("_set", F.explode(F.sequence(F.lit(1), F.lit(sets)))))
    for sweep in range(sweeps):
        for c in holes:
            others = [o for o in use if o != c]
            seen_rows = rows.where(~F.col(f"_m_{c}") & ~F.col("_skip"))
            found = grams(seen_rows, "_set", [*others, c], mean)
            fits = [solve(found[s], c, others) for s in range(1, sets + 1)]
            of_set = [F.element_at(F.array(*[F.lit(float(f["coefficients"][j]["b"])) for f in fits]), F.col("_set")) for j in range(len(others) + 1)]
            guess = sum((b * col(o) for b, o in zip(of_set[1:], others, strict=True)), of_set[0])
            spread = F.element_at(F.array(*[F.lit(math.sqrt(max(0.0, f["mse"]))) for f in fits]), F.col("_set"))
            noise = normal(col(row_id), seed, F.col("_set"), sweep, c) * spread
            rows = rows.withColumn(c, F.when(F.col(f"_m_{c}"), guess + noise).otherwise(col(c)))
        if sweep % 2:
            rows = written(rows)
    return written(rows.select("_set", *[(F.when(F.col("_skip") & F.col(f"_m_{c}"), None).otherwise(col(c)) if c in holes else col(c)).alias(c) for c in df.columns]))


def _by_pattern(start: DataFrame, row_id: str, use: list[str], holes: list[str], mean: dict[str, float], sets: int, sweeps: int, seed: int) -> DataFrame:
    """``sets`` times the rows with ``holes`` filled.

    A row's vector is 1, its columns less ``mean`` (0 where missing), and the noise of each hole and sweep
    (0 where there is none). Each filled cell is ``mean`` and coefficients times that vector.
    """
    at = {c: 1 + j for j, c in enumerate(use)}
    noise = {(c, t): 1 + len(use) + j * sweeps + t for j, c in enumerate(holes) for t in range(sweeps)}
    size = 1 + len(use) + len(noise)
    bit = {c: 1 << j for j, c in enumerate(holes)}
    start = start.withColumn("_p", sum((F.col(f"_m_{c}").cast("int") * b for c, b in bit.items()), F.lit(0)))
    few, every_set = F.col("_p").isin(0, *bit.values()), F.explode(F.sequence(F.lit(1), F.lit(sets))).alias("_set")
    dev = [col(c) - F.lit(float(mean[c])) for c in use]
    seen = start.where(~F.col("_skip"))

    def noises(c: str) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(sweeps - 1)), lambda t: normal(col(row_id), seed, F.col("_set"), t, c))
        return F.coalesce(F.when(F.col(f"_m_{c}"), each), F.array(*[F.lit(0.0)] * sweeps))

    def products(batches):
        sums = {}
        for b in batches:
            key, v = b.column("key").to_numpy(), b.column("v").flatten().to_numpy().reshape(-1, size)
            for k in np.unique(key):
                own = v[key == k]
                sums[k] = sums.get(k, 0) + own.T @ own
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(k)] * size**2, pa.int32()), pa.array(np.arange(size**2), pa.int32()), pa.array(m.ravel())], names=["key", "i", "m"])

    known = {(p, k): np.zeros((size, size)) for p in range(1 << len(holes)) for k in range(1, sets + 1)}
    # rows that lack one column or none: products of their values, then of their noise, sweep by sweep
    for p, g in grams(seen.where(few), "_p", use, mean).items():
        away = np.concatenate([[1.0], g.mean - np.array([mean[c] for c in use])])
        raw = g.n * np.outer(away, away)
        raw[1:, 1:] += g.cross
        for k in range(1, sets + 1):
            known[p, k][: len(raw), : len(raw)] = raw
    lacking = F.coalesce(*[F.when(F.col("_p") == b, F.lit(c)) for c, b in bit.items()])
    one = seen.where(few & (F.col("_p") > 0)).select("_p", lacking.alias("_c"), col(row_id).alias("_id"), *[d.alias(f"d{j}") for j, d in enumerate(dev)], every_set)
    one = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(sweeps - 1))).alias("_t")).withColumn("z", normal(F.col("_id"), seed, F.col("_set"), F.col("_t"), F.col("_c")))
    name = {b: c for c, b in bit.items()}
    for r in one.groupBy("_p", "_set", "_t").agg(F.sum(F.col("z") * F.col("z")), F.sum("z"), *[F.sum(F.col("z") * F.col(f"d{j}")) for j in range(len(use))]).collect():
        m, i = known[r[0], r[1]], noise[name[r[0]], r[2]]
        m[i, i] = r[3]
        m[i, : 1 + len(use)] = m[: 1 + len(use), i] = r[4:]
    # rows that lack several: all products
    many = start.where(~few).select("*", every_set)
    vector = F.concat(F.array(F.lit(1.0), *dev), *map(noises, holes)).alias("v")
    got = many.where(~F.col("_skip")).select((F.col("_p") * sets + F.col("_set") - 1).alias("key"), vector).mapInArrow(products, "key int, i int, m double")
    for r in got.groupBy("key", "i").agg(F.sum("m").alias("m")).toArrow().to_batches():
        for k, i, m in zip(*(r.column(j).to_pylist() for j in range(3)), strict=True):
            known[k // sets, k % sets + 1][divmod(i, size)] = m

    unit = np.eye(size)
    state = {(p, k, c): np.zeros(size) for p, k in known for c in holes if p & bit[c]}
    for k in range(1, sets + 1):
        for t in range(sweeps):
            for c in holes:
                names = [*[o for o in use if o != c], c]
                total = np.zeros((len(names) + 1, len(names) + 1))
                for p in range(1 << len(holes)):
                    if not p & bit[c]:
                        a = np.stack([unit[0], *[state.get((p, k, o), unit[at[o]]) for o in names]])
                        total += a @ known[p, k] @ a.T
                n, near = total[0, 0], np.array([mean[o] for o in names])
                away = total[0, 1:] / n
                fit = solve(Gram(names, n, near + away, total[1:, 1:] - n * np.outer(away, away)), c, names[:-1])
                b = np.array([x["b"] for x in fit["coefficients"]])
                for p in range(1 << len(holes)):
                    if p & bit[c]:
                        guess = (b[0] + b[1:] @ near[:-1] - near[-1]) * unit[0] + sum(x * state.get((p, k, o), unit[at[o]]) for x, o in zip(b[1:], names, strict=False))
                        state[p, k, c] = guess + math.sqrt(max(0.0, fit["mse"])) * unit[noise[c, t]]

    def of_set(numbers: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(x)) for x in numbers]), F.col("_set"))

    done = start.where(few).select("*", every_set)
    for c in holes:
        own = [state[bit[c], k, c] for k in range(1, sets + 1)]
        value = sum((of_set([v[at[o]] for v in own]) * (col(o) - F.lit(float(mean[o]))) for o in use if o != c), of_set([v[0] + mean[c] for v in own]))
        value = value + of_set([v[noise[c, sweeps - 1]] for v in own]) * normal(col(row_id), seed, F.col("_set"), sweeps - 1, c)
        done = done.withColumn(c, F.when(F.col("_p") == bit[c], value).otherwise(col(c)))
    filled = many.withColumn("_v", vector)
    for c in holes:
        each = F.array(*[F.array(*[F.lit(float(x)) for x in state.get((p, k, c), np.zeros(size))]) for p in range(1 << len(holes)) for k in range(1, sets + 1)])
        terms = F.zip_with(F.element_at(each, F.col("_p") * sets + F.col("_set")), F.col("_v"), lambda x, y: x * y)
        filled = filled.withColumn(c, F.when(F.col(f"_m_{c}"), F.lit(float(mean[c])) + F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)).otherwise(col(c)))
    return done.unionByName(filled.drop("_v"))


def draw_categories(df: DataFrame, row_id: str, column: str, seed: int = SEED) -> DataFrame:
    """Nulls of a column drawn from its observed proportions, by keyed numbers."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("_v")).agg(F.count("*").alias("n"))
    order = Window.orderBy("_v")  # levels only
    share = counts.select("_v", (F.sum("n").over(order) / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("_upto"))
    share = share.select("_v", "_upto", F.lag("_upto", 1, -1.0).over(order).alias("_from"))
    # a range join by equal slices of the numbers, so that any count of levels does
    piece = lambda x: F.floor(x * 4096).cast("int")
    share = share.withColumn("_piece", F.explode(F.sequence(piece(F.greatest("_from", F.lit(0.0))), piece(F.col("_upto")))))
    rows = df.withColumn("_u", F.when(col(column).isNull(), uniform(col(row_id), seed, column))).withColumn("_slice", piece(F.col("_u")))
    found = rows.join(share, (F.col("_slice") == F.col("_piece")) & (F.col("_u") > F.col("_from")) & (F.col("_u") <= F.col("_upto")), "left")
    return found.withColumn(column, F.coalesce(col(column), F.col("_v"))).select(*[col(c) for c in df.columns])


def rubin(estimates: list[float], variances: list[float], complete_df: float | None = None, alpha: float = 0.05) -> dict:
    """Rubin's rules; with ``complete_df`` Barnard and Rubin's degrees of freedom."""
    m = len(estimates)
    q, u = float(np.mean(estimates)), float(np.mean(variances))
    b = float(np.var(estimates, ddof=1)) if m > 1 else 0.0
    t = u + (1 + 1 / m) * b
    share = (1 + 1 / m) * b / t if t > 0 else 0.0
    dof = (m - 1) / share**2 if share > 0 else math.inf
    if complete_df is not None:
        seen = (complete_df + 1) / (complete_df + 3) * complete_df * (1 - share)
        dof = seen if math.isinf(dof) else dof * seen / (dof + seen)
    crit = dist.norm_ppf(1 - alpha / 2) if math.isinf(dof) else dist.t_ppf(1 - alpha / 2, dof)
    return {"estimate": q, "within": u, "between": b, "total": t, "df": dof, "lambda": share, "ci_low": q - crit * math.sqrt(t), "ci_high": q + crit * math.sqrt(t)}


def compare_missing(df: DataFrame, imputed: DataFrame, columns: list[str], shrink: float = 0.02) -> DataFrame:
    """``variable, strategy, mean, sd, shrinks`` of complete cases, mean fill and imputation."""
    base = df.agg(*[F.avg(number_of(df, c)) for c in columns], *[F.stddev_samp(number_of(df, c)) for c in columns]).first()
    k = len(columns)
    means = dict(zip(columns, base[:k], strict=True))
    filled = df.agg(*[F.stddev_samp(F.coalesce(number_of(df, c), F.lit(means[c]))) for c in columns]).first()
    per_set = imputed.groupBy("_set").agg(*[F.avg(col(c)).alias(f"m{j}") for j, c in enumerate(columns)], *[F.stddev_samp(col(c)).alias(f"s{j}") for j, c in enumerate(columns)])
    many = per_set.agg(*[F.avg(f"m{j}") for j in range(k)], *[F.avg(f"s{j}") for j in range(k)]).first()
    rows = []
    for j, c in enumerate(columns):
        sd = base[k + j]
        for name, mean, s in (("complete", means[c], sd), ("mean fill", means[c], filled[j]), ("imputed", many[j], many[k + j])):
            rows.append((c, name, mean, s, bool(sd and s is not None and (sd - s) / sd > shrink)))
    return df.sparkSession.createDataFrame(rows, "variable string, strategy string, mean double, sd double, shrinks boolean")
