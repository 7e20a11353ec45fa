"""Shared pieces: tables in the cluster's shared folder, column names that can't clash,
bounded memory of worker processes, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in ``spark.checkpoint.dir``, which all executors see.

    Where that is unset, a local master gets a temporary folder and any other
    master the warehouse, which is shared as well. All folders of one application lie
    in one, named by its id, which can be removed as soon as its results are written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local["):
            base = f"file://{tempfile.gettempdir()}/fieldmark-tables"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir") + "/_fieldmark"
    return f"{base}/fieldmark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again.

    It cuts the lineage: a lost executor costs no recomputation, since no rows
    are kept on executors.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns ``c0, c1 ...``, and the new name of each: nothing added to it can clash."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.select(*[named(c).alias(n) for c, n in names.items()]), names


def without(df: DataFrame, *names: str) -> list[Column]:
    """All columns of ``df`` but those of the given names, whatever their case."""
    gone = {n.lower() for n in names}
    return [named(c) for c in df.columns if c.lower() not in gone]


#: Bytes of an Arrow batch of texts; Spark's own bound is 64 MB, of which a task holds several copies.
BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches in which texts go to Python, for the rest of the session.

    A size that the session has been given stays.
    """
    if str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


class Memo(dict):
    """Results that a worker process remembers, bounded in bytes; a full one takes no more."""

    #: What one entry costs beside its key and value.
    ENTRY = 200

    def __init__(self, limit: int) -> None:
        self.limit = self.room = limit

    def keep(self, key: str | bytes, value: object, size: int = 0) -> bool:
        need = len(key) + size + self.ENTRY
        if need > self.room:
            return False
        self.room -= need
        self[key] = value
        return True

    def clear(self, limit: int | None = None) -> None:
        super().clear()
        self.room = self.limit = self.limit if limit is None else limit


def tidied(batches: Iterator, *memos: Memo) -> Iterator:
    """``batches``; at their end the memos are emptied and free memory goes back to
    the system, since a worker process lives on and serves later stages."""
    try:
        yield from batches
    finally:
        for memo in memos:
            memo.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


class Forest:
    """Union-find over few local items; ``join`` tells whether it merged two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = self.parent[self.parent[p]]
            p = self.parent[p]
        self.parent[x] = p
        return p

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def components(edges: DataFrame) -> DataFrame:
    """``node, component_id`` of every node with a link: the smallest node reachable.

    Alternates large-star and small-star rounds until the links no longer change.
    Each round is two aggregations and two joins on narrow rows; hubs are
    pre-aggregated, and the joins are plain ones that AQE can split.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        # exclusive or can't overflow, whatever the ids; the rows are distinct
        seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = saved(small.where("a <> b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
