"""Mixing to target weights by iterative proportional fitting, on DataFrame and SQL
functions only.

Documents are counted into cells of their margins (source, language, topic). The
cells' token shares are raked: in turn, each margin's shares are scaled to its
target, until all margins agree. A budget of tokens is then spread over the cells
by those shares; documents are drawn with the probability that gives each cell its
tokens in expectation. Cells too small for their part are taken whole and the rest
share what is left (the scale is found in closed form from the sorted cells).

Only cells travel after the one aggregation: their number is bounded by the product
of the margins' values, whatever the number of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import named, saved

#: Sweeps over all margins between two looks at the error, and at most.
SWEEPS, MOST_SWEEPS = 5, 60


def tokens(text: Column) -> Column:
    """Words between ASCII white space; 0 for null and for a text without any."""
    body = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, 0).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def uniform(cells: DataFrame, margin: str) -> DataFrame:
    """Equal target shares for every value of a margin that holds tokens."""
    return cells.where("tokens > 0").select(F.col(margin).alias("value")).distinct().withColumn("share", F.lit(1.0))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-9) -> DataFrame:
    """``cells`` with tokens, plus ``share``: raked shares that sum to 1.

    ``targets``: for each margin ``value, share``; shares are relative, a value not
    named has none, and null is a value of its own. Values without tokens drop out
    and the others' shares are scaled to 1. Margins that contradict each other end
    after ``MOST_SWEEPS`` sweeps with the last margin met.
    """
    out = cells.where("tokens > 0").withColumn("share", F.col("tokens").cast("double"))
    for m, target in targets.items():
        named = target.select(F.col("value").alias("_value"), F.col("share").cast("double").alias(f"_{m}"))
        out = out.join(named, F.col(m).eqNullSafe(F.col("_value")), "left").drop("_value")
        out = out.withColumn(f"_{m}", F.coalesce(f"_{m}", F.lit(0.0)))
    alive = reduce(lambda a, b: a & b, [F.col(f"_{m}") > 0 for m in targets], F.lit(True))
    out = saved(out.where(alive))
    totals = [out.select(m, f"_{m}").distinct().agg(F.sum(f"_{m}")).first()[0] for m in targets]
    for m, total in zip(targets, totals, strict=True):
        out = out.withColumn(f"_{m}", F.col(f"_{m}") / F.lit(total))
    done = 0
    while done < MOST_SWEEPS:
        for _ in range(SWEEPS):
            for m in targets:
                out = out.withColumn("share", F.col("share") * F.col(f"_{m}") / F.sum("share").over(Window.partitionBy(m)))
        done += SWEEPS
        out = saved(out)
        worst = out.select(*[F.abs(F.sum("share").over(Window.partitionBy(m)) / F.col(f"_{m}") - 1).alias(m) for m in targets])
        error = worst.agg(F.max(F.greatest(*targets, F.lit(0.0)))).first()[0]
        if error is None or error < tolerance:
            break
    return out.select(*cells.columns, "share")


def probabilities(raked: DataFrame, budget: float, total: float) -> DataFrame:
    """``raked`` plus ``weight`` (share over the part of ``total`` tokens) and ``probability``.

    The probability is ``min(1, scale * share / tokens)`` with the one scale at which
    the expected tokens are ``budget`` tokens (1 where all tokens are fewer).
    """
    need = F.col("tokens") / F.col("share")  # the scale at which a cell is used up
    order = Window.orderBy(need, *[c for c in raked.columns if c not in ("tokens", "share")])
    full = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
    # one window over cells only: their number is bounded by the margins' values
    steps = raked.select(need.alias("need"), ((F.lit(float(budget)) - full) / left).alias("scale"))
    scale = steps.where("scale <= need").agg(F.min_by("scale", "need")).first()[0]
    p = F.lit(1.0) if scale is None else F.least(F.lit(1.0), F.lit(scale) * F.col("share") / F.col("tokens"))
    return raked.select("*", (F.col("share") * F.lit(float(total)) / F.col("tokens")).alias("weight"), p.alias("probability"))


def draw(id: Column, seed: str = "mix") -> Column:
    """A keyed number in [0, 1) for each id, the same wherever the row lies."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, targets: dict[str, DataFrame | dict | None], fraction: float, id: str = "doc_id", text: str = "text", seed: str = "mix") -> DataFrame:
    """``docs`` plus ``n_tokens, weight, probability, kept``.

    ``targets``: for each margin, a column of ``docs``, the shares of its values, as
    a dict or as a frame ``value, share``; None: equal shares. ``fraction``: the part
    of the input's tokens to keep in expectation. Documents of values without a
    target, and those without tokens, have weight and probability 0 and go; a null is a
    value of its own. Rows with equal ids are kept or left together; null ids count as
    one id. Long texts are counted whole. An empty table gives an empty result. Columns
    of ``docs`` that have one of the four names are replaced, all others stay.
    """
    spark = docs.sparkSession
    at = {c.lower(): f"c{k}" for k, c in enumerate(docs.columns)}
    counted = docs.select(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).withColumn("n_tokens", tokens(F.col(at[text.lower()])))
    names = {m: f"m{k}" for k, m in enumerate(targets)}
    value = {n: F.col(at[m.lower()]).cast("string") for m, n in names.items()}
    cells = saved(counted.groupBy(*[v.alias(n) for n, v in value.items()]).agg(F.sum("n_tokens").alias("tokens")))
    wanted = {}
    for m, n in names.items():
        t = targets[m]
        if isinstance(t, dict):
            t = spark.createDataFrame([(k, float(v)) for k, v in t.items()], "value string, share double")
        wanted[n] = uniform(cells, n) if t is None else t
    raked = rake(cells, wanted)
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    found = saved(probabilities(raked, fraction * total, total)).drop("tokens", "share")
    same = reduce(lambda a, b: a & b, [v.eqNullSafe(F.col(n)) for n, v in value.items()])
    # the cells' number is bounded by the margins; a plain join where it isn't small
    out = counted.join(F.broadcast(found) if found.count() <= 100_000 else found, same, "left")
    p = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    w = F.when(F.col("n_tokens") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
    results = {"n_tokens": F.col("n_tokens"), "weight": w, "probability": p, "kept": draw(F.col(at[id.lower()]), seed) < p}
    kept = [F.col(at[c.lower()]).alias(c) for c in docs.columns if c.lower() not in results]
    return out.select(*kept, *[c.alias(n) for n, c in results.items()])
