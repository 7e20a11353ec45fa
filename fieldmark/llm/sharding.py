"""Minimax contiguous sharding, on DataFrame and SQL functions only.

Groups of equal texts are atomic and stand in the order of their text's digest.
The largest shard is made as small as that order allows: a binary search for the
smallest feasible shard capacity, each capacity checked by greedy filling, and the
shards are cut where that capacity cuts them.

Running sums over all rows come from a range partitioning: sums inside each
partition plus the sums of the partitions before it, so a group may span many
partitions and no task sees an unbounded one. The search needs few of the running
sums: an aggregation into a bounded number of buckets tells, for most capacities,
whether they fit whatever lies inside the buckets; only the stretches where a cut of
the others can fall are looked at more closely, until they are few enough to read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import named, saved

#: Buckets of one look at the running sums, and running sums that are read as they are.
BUCKETS, READ = 10_000, 200_000


def _running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums over the global order, each row included."""
    dealt = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    # one row per partition: bounded by the number of partitions
    return dealt.join(F.broadcast(starts), "_part").select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


class Ends:
    """What is known of the sorted running sums: buckets with their least and greatest."""

    def __init__(self, buckets: list[tuple[int, int]]) -> None:
        self.least, self.greatest = [a for a, _ in buckets], [b for _, b in buckets]

    def below(self, bound: int, surely: bool) -> int:
        """The greatest running sum up to ``bound``: at least (``surely``) or at most."""
        k = bisect_right(self.least, bound) - 1
        if k < 0:
            return 0
        return self.greatest[k] if self.greatest[k] <= bound else self.least[k] if surely else bound

    def fill(self, capacity: int, shards: int, surely: bool) -> list[int]:
        """Cuts of greedy filling; the last is the total if the capacity suffices."""
        cuts, total = [0], self.greatest[-1]
        while len(cuts) <= shards and cuts[-1] < total:
            cuts.append(self.below(cuts[-1] + capacity, surely))
        return cuts[1:]

    def smallest(self, low: int, high: int, shards: int, surely: bool) -> int:
        """The smallest capacity above ``low`` that suffices; ``high`` does."""
        while low + 1 < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, surely)[-1] >= self.greatest[-1]:
                high = middle
            else:
                low = middle
        return high


def minimax_capacity(ends: DataFrame, shards: int, total: int, largest: int, buckets: int = BUCKETS, read: int = READ) -> tuple[int, list[int]]:
    """The smallest capacity for ``shards`` contiguous shards, and the cuts it makes.

    ``ends``: column ``end`` with the running size at the end of each group. Each look
    is one aggregation to at most ``buckets`` rows and a few, whatever the number of groups.
    """
    if not total:
        return 0, []
    fair = -(-total // shards)
    low, high = max(largest, fair) - 1, fair + largest
    windows, known, width = [(1, total)], [], None
    while True:
        # a look that showed too little is followed by a finer one
        before, width = width, sum(b - a + 1 for a, b in windows)
        buckets = buckets if before is None or 2 * width <= before else 4 * buckets
        # the windows' running sums, by buckets of equal width; a read window has buckets of width 1
        step = max(1, -(-width // buckets))
        window = F.coalesce(*[F.when(F.col("end").between(a, b), F.struct(F.lit(k).alias("w"), F.floor((F.col("end") - a) / step).alias("b"))) for k, (a, b) in enumerate(windows)])
        got = ends.select("end", window.alias("at")).where("at is not null").groupBy("at").agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count("*").alias("n")).collect()
        outside = [x for x in known if not any(a <= x[0] and x[1] <= b for a, b in windows)]
        known = sorted([*outside, *[(r["a"], r["b"], r["n"]) for r in got]])
        seen = Ends([x[:2] for x in known])
        # what suffices at the least and at the best that the buckets may hold
        high = seen.smallest(low, high, shards, True)
        low = seen.smallest(low, high, shards, False) - 1
        first, last = [0, *seen.fill(low + 1, shards, True)], [0, *seen.fill(high, shards, False)]
        last += [total] * (len(first) - len(last))
        spans = [(a + low + 1, b + high) for a, b in zip(first, last, strict=False)]
        dark = [x for x in known if x[0] < x[1] and any(x[0] <= b and a <= x[1] for a, b in spans)]
        if not dark:
            return high, seen.fill(high, shards, True)
        windows = []
        for a, b, _ in dark:
            joined = windows and not any(windows[-1][1] < x[0] < a for x in known)
            windows[-1:] = [(windows[-1][0], b)] if joined else [*windows[-1:], (a, b)]
        while len(windows) > 2 * shards:  # join those with the least between them
            k = min(range(len(windows) - 1), key=lambda i: windows[i + 1][0] - windows[i][1])
            windows[k : k + 2] = [(windows[k][0], windows[k + 1][1])]
        if sum(n for a, b, n in known if any(c <= a and b <= d for c, d in windows)) <= read:
            inside = F.lit(False)
            for a, b in windows:
                inside |= F.col("end").between(a, b)
            exact = [(r["end"], r["end"], 1) for r in ends.where(inside).select("end").distinct().collect()]
            seen = Ends(sorted(x[:2] for x in [*exact, *[x for x in known if not any(a <= x[0] and x[1] <= b for a, b in windows)]]))
            high = seen.smallest(low, high, shards, True)
            return high, seen.fill(high, shards, True)


def shard_by_bytes(docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Size: UTF-8 bytes of the text plus ``overhead``. Equal texts share a shard; a
    null text equals an empty one. ``slot`` counts from 0 in each shard without
    gaps, in the order of text digest and id (null ids first; rows alike in both
    are interchangeable). With fewer groups than shards the last shards stay
    empty. Texts of any length are sized and hashed whole; other columns are not
    read. An empty table gives an empty result.
    """
    body = F.coalesce(named(text), F.lit(""))
    rows = docs.select(named(id).alias("id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("digest"))
    placed = saved(_running(rows.withColumn("one", F.lit(1).cast("long")), ["digest", "id"], {"end": "size", "row": "one"}))
    groups = placed.groupBy("digest").agg(F.max("end").alias("end"), F.max("row").alias("row"), F.sum("size").alias("bytes"))
    groups = saved(groups.repartitionByRange("end").sortWithinPartitions("end"))
    total, largest = groups.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    _, cuts = minimax_capacity(groups, shards, total, largest)
    # one row per shard
    firsts = {r["end"]: r["row"] for r in groups.where(F.col("end").isin(cuts)).select("end", "row").collect()} if cuts else {}
    ends = [0, *cuts]
    rows_before = F.array(*[F.lit(firsts.get(e, 0)).cast("long") for e in ends])
    shard = F.lit(0)
    for e in cuts[:-1]:
        shard = shard + (F.col("end") > e).cast("int")
    placed = placed.withColumn("shard", shard.cast("int"))
    return placed.select(
        F.col("id").alias(id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - 1 - F.element_at(rows_before, F.col("shard") + 1)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
