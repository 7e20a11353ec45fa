"""Hard negatives by distributed radix selection.

A row's score is its integer inner product with an anchor. Each anchor's positives are
the best rows of its own label; each pair of anchor and positive opens a window of
scores, a share of the positive's, from which the best rows of other labels are
taken. All are found by one selection: tasks count the scores of their rows in each
window's buckets, the counts are added up, the bucket that holds the k-th score becomes
the new window, and so on digit by digit until the k-th score is known. Only then
are rows gathered, those that reach it and no others.

Anchors are the query set. They are taken in chunks of bounded size, each broadcast to one
pass over all rows per digit, so vectors are never shuffled and no group is ever whole in
one place. What the driver holds are one chunk's anchors and windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import named, saved, shared_dir

#: Anchors of a chunk, about and at most; bits of a digit; rows and anchors multiplied at once.
CHUNK, MOST, BITS, LOT, PART = 2048, 4096, 8, 4096, 128
#: Squared lengths from which on a score may not fit a long.
LONGEST = 2.0**62
#: Below this bound on its partial sums a product of doubles is exact.
EXACT = 2.0**53


@dataclass
class Windows:
    """Windows of one chunk, ordered by anchor: scores from ``lo`` to ``hi`` of rows with
    (``same``) or without the anchor's label, of which ``need`` are wanted."""

    ids: np.ndarray  # of the anchors
    labels: np.ndarray
    vectors: list[np.ndarray]
    anchor: np.ndarray  # of each window, a place in ids
    lo: np.ndarray
    hi: np.ndarray
    need: np.ndarray
    same: bool

    @property
    def shift(self) -> np.ndarray:
        """Bits below the current digit of each window."""
        width = np.maximum(self.hi - self.lo, 0)
        return np.maximum(np.ceil(np.log2(width.astype(np.float64) + 1)).astype(np.int64) - BITS, 0)

    def pairs(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, row ids and scores of all rows that lie in a window, lot by lot."""
        n = len(self.ids)
        first, count = np.searchsorted(self.anchor, np.arange(n)), np.bincount(self.anchor, minlength=n)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, self.anchor, self.lo)
        np.maximum.at(high, self.anchor, self.hi)
        sizes = np.array([len(v) for v in self.vectors], np.int64)
        matrices = {d: (own := np.flatnonzero((sizes == d) & (count > 0)), np.array([self.vectors[i] for i in own], np.int64).reshape(len(own), d)) for d in np.unique(sizes)}
        for ids, labels, d, rows in _lots(batches):
            own, matrix = matrices.get(d, (np.zeros(0, np.int64), None))
            names, codes = np.unique(labels, return_inverse=True)
            at = np.minimum(np.searchsorted(names, self.labels), len(names) - 1)
            code = np.where(names[at] == self.labels, at, -1)
            for p in range(0, len(own), PART):
                some = own[p : p + PART]
                scores = products(matrix[p : p + PART], rows)
                inside = (scores >= low[some, None]) & (scores <= high[some, None]) & ((code[some, None] == codes) == self.same)
                if self.same:
                    inside &= self.ids[some, None] != ids
                a, r = np.nonzero(inside)
                s, a, r = scores[a, r], some[a], ids[r]
                for j in range(int(count[some].max())):
                    w = np.minimum(first[a] + j, len(self.anchor) - 1)
                    hit = (j < count[a]) & (s >= self.lo[w]) & (s <= self.hi[w])
                    yield w[hit], r[hit], s[hit]

    def histogram(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each window by the next digit, counted from the top."""
        shift, size = self.shift, 1 << BITS
        counts = np.zeros(len(self.anchor) * size, np.int64)
        for w, _, s in self.pairs(batches):
            counts += np.bincount(w * size + ((self.hi[w] - s) >> shift[w]), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([at // size, at % size, counts[at], self.need[at // size]], names=["w", "digit", "n", "need"])

    def gather(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows above each window's lowest score, and of those at it the ``need`` with the smallest ids."""
        found, size = [], 0
        for w, r, s in self.pairs(batches):
            found.append(self._least(w, r, s))
            size += len(found[-1][0])
            if size > 1_000_000:
                found = [self._least(*map(np.concatenate, zip(*found, strict=True)))]
                size = -len(found[0][0])  # what is left doesn't count again
        w, r, s = self._least(*map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([w, r, s], names=["w", "id", "score"])

    def _least(self, w: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((r, -s, w))
        w, r, s = w[order], r[order], s[order]
        tie = s == self.lo[w]
        place = np.cumsum(tie)
        start = np.searchsorted(w, w)  # of each window's rows
        kept = ~tie | (place - place[start] + tie[start] <= self.need[w])
        return w[kept], r[kept], s[kept]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no partial sum can reach
    their limit, else in 64-bit integers, whose overflows cancel out."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if len(x) and len(y) and np.sqrt((x * x).sum(axis=1).max() * (y * y).sum(axis=1).max()) < EXACT / 2:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def _lots(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Ids, labels, length and vectors, by length and at most ``LOT`` rows at once."""
    for whole in batches:
        for at in range(0, whole.num_rows, LOT):
            batch = whole.slice(at, LOT)
            q = batch.column("q")
            ids, labels = batch.column("id").to_numpy(zero_copy_only=False), np.array(batch.column("label").to_pylist(), object).astype(str)
            values, ends = q.flatten().to_numpy(), np.cumsum(lengths := np.diff(q.offsets.to_numpy()))
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                yield ids[own], labels[own], int(d), values[(ends[own] - d)[:, None] + np.arange(d)]


def _over(rows: DataFrame, windows: Windows, task: Callable, schema: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(windows)
    return rows.mapInArrow(lambda batches: task(sent.value, batches), schema)


def _selected(rows: DataFrame, windows: Windows) -> DataFrame:
    """``w, id, score, rank``: each window's first ``need`` rows by score, then by id."""
    open_, done = np.flatnonzero(windows.lo <= windows.hi), windows
    done = replace(windows, lo=windows.lo.copy(), need=windows.need.copy())
    now = replace(windows, anchor=windows.anchor[open_], lo=windows.lo[open_], hi=windows.hi[open_], need=windows.need[open_])
    every = Window.partitionBy("w").orderBy("digit")
    while len(open_):
        shift = now.shift
        counted = _over(rows, now, Windows.histogram, "w long, digit long, n long, need long").groupBy("w", "digit").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
        reached = counted.withColumn("upto", F.sum("n").over(every)).where("upto >= need and upto - n < need")
        # one row a window, and the windows of one chunk are at most MOST anchors times their positives
        found = reached.selectExpr("w", "digit", "need - (upto - n) as need").toPandas().sort_values("w").astype(np.int64)
        w, digit, need = (found[c].to_numpy() for c in ("w", "digit", "need"))  # a window without a row takes all it has
        hi = now.hi[w] - (digit << shift[w])
        lo = np.maximum(now.lo[w], hi - (np.int64(1) << shift[w]) + 1)
        done.lo[open_[w]], done.need[open_[w]] = lo, need
        more = lo < hi
        open_ = open_[w[more]]
        now = replace(now, anchor=now.anchor[w[more]], lo=lo[more], hi=hi[more], need=need[more])
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return _over(rows, done, Windows.gather, "w long, id long, score long").withColumn("rank", place)


def quantised(vectors: DataFrame, id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``id, label, q`` of the rows that take part."""
    x = named(vector)
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))  # NaN is above infinity
    square = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = vectors.where(named(id).isNotNull() & named(label).isNotNull() & x.isNotNull() & finite)
    return rows.select(named(id).cast("long").alias("id"), named(label).cast("string").alias("label"), q.alias("q")).where(square < LONGEST)


def mine(vectors: DataFrame, anchors: str | Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors``: condition on ``vectors``' columns. Components become ``floor(scale * x)``. An
    anchor's positives are its first rows of equal label and another id; of each, the
    first ``negatives`` rows of another label whose score is ``low`` to ``high`` hundredths of
    the positive's are returned, all if fewer; higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part,
    nor do those whose quantised length is 2**31 or more, since their scores may not fit a long.
    Only vectors of equal length are compared; empty ones score 0. A row that is given more than
    once counts each time, but is one anchor. A positive of negative score has no window.
    Further columns are ignored; an empty table or one without anchors gives no rows.
    """
    spark = vectors.sparkSession
    rows = saved(quantised(vectors, id, vector, label, scale))
    asked = quantised(vectors.where(anchors if isinstance(anchors, Column) else F.expr(anchors)), id, vector, label, scale)
    asked = saved(asked.distinct().withColumn("h", F.xxhash64("id", "label", "q")))
    longest, n = rows.agg(F.max(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).first()[0], asked.count()
    out, path = None, shared_dir(spark)
    chunks = -(-n // CHUNK)
    for c in range(chunks):
        # the anchors are distinct, so hashes deal them evenly: twice the mean is out of reach
        own = asked.where(F.pmod("h", F.lit(chunks)) == c).limit(MOST + 1).toPandas().sort_values("id")
        if len(own) > MOST:
            raise ValueError(f"more than {MOST} anchors in a chunk")
        ids, labels, q = own["id"].to_numpy(np.int64), own["label"].to_numpy(object).astype(str), [np.array(v, np.int64) for v in own["q"]]
        most = np.array([np.ceil(np.sqrt((v.astype(np.float64) ** 2).sum() * longest)) for v in q]).astype(np.int64) + 1
        base = Windows(ids, labels, q, np.arange(len(ids)), -most, most, np.full(len(ids), positives, np.int64), True)
        best = _selected(rows, base).where(F.col("rank") <= positives).toPandas().astype(np.int64).sort_values(["w", "rank"])
        bounds = [(-(-low * s // 100), high * s // 100) for s in best["score"].tolist()]
        wide = np.array(bounds, np.int64).reshape(-1, 2)
        pairs = replace(base, anchor=best["w"].to_numpy(), lo=wide[:, 0], hi=wide[:, 1], need=np.full(len(best), negatives, np.int64), same=False)
        named_ = spark.createDataFrame(pd.DataFrame({"w": np.arange(len(best)), "anchor_id": ids[best["w"]], "positive_id": best["id"].to_numpy(), "positive_score": best["score"].to_numpy()}), "w long, anchor_id long, positive_id long, positive_score long")
        taken = _selected(rows, pairs).where(F.col("rank") <= negatives).join(F.broadcast(named_), "w")
        out = taken.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(path) if chunks else spark.createDataFrame([], schema)
