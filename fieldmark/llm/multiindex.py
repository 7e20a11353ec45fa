"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut into halves, each half with a codebook of its own; a pair of
codes is a cell of the product grid. A vector's neighbours lie in cells near it: the
multi-sequence traversal takes the two sorted lists of centroid distances and
visits cells in the order of their sum, until a bound that reached the target
recall on the pairs of a bounded sample. What is found there is verified by the
cosine in double precision.

Each pair of cells is compared from one side only (the lower cell visits the higher),
so no pair counts twice. A crowded cell is dealt into blocks that visit one another.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import components, named, saved

#: Vectors that the codebooks and the bound are fitted on (or 16 for each centroid, if more); vectors of a block (and, about, of a cell); cells of the grid, at most.
SAMPLE, BLOCK, CELLS = 8192, 4096, 1_000_000
#: Vectors placed at once.
LOT = 1000


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square leaves the range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None], 0)


def codebook(x: np.ndarray, k: int, sweeps: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's iterations from distinct rows."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(sweeps):
        code = _distances(x, c).argmin(axis=1)
        sums, n = np.zeros_like(c), np.bincount(code, minlength=len(c))
        np.add.at(sums, code, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class MultiIndex:
    """Codebooks of both halves, occupied cells with their blocks, and the bound."""

    def __init__(self, sample: np.ndarray, centroids: int, similarity: float, recall: float) -> None:
        cut = sample.shape[1] // 2
        self.cut, self.similarity = cut, similarity
        self.books = codebook(sample[:, :cut], centroids), codebook(sample[:, cut:], centroids, seed=8)
        self.occupied, self.blocks = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.margin = self._calibrated(sample, recall)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.cut], self.books[0]), _distances(x[:, self.cut :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def fill(self, cells: np.ndarray, sizes: np.ndarray, block: int) -> None:
        """Name the occupied cells and the number of blocks of each."""
        order = np.argsort(cells)
        self.occupied, self.blocks = cells[order], -(-sizes[order] // block)

    def found(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the cells that are occupied, and their numbers of blocks."""
        at = np.minimum(np.searchsorted(self.occupied, cells), len(self.occupied) - 1)
        hit = self.occupied[at] == cells
        return cells[hit], self.blocks[at[hit]]

    def _calibrated(self, x: np.ndarray, recall: float) -> float:
        """How far past its nearest cell a vector must look to meet all of its partners.

        The largest of the quantiles over the sample's vectors that have partners, and over
        made-up partners at the least similarity: in random directions, and in directions
        within either half. Partners in the sample alone may all be of one tight group.
        """
        a, b = self.halves(x)
        i, j = a.argmin(axis=1), b.argmin(axis=1)
        least = a.min(axis=1) + b.min(axis=1)
        need = []
        for at in range(0, len(x), 512):
            linked = x[at : at + 512] @ x.T >= self.similarity
            linked[np.arange(len(linked)), at + np.arange(len(linked))] = False
            for p in np.flatnonzero(linked.any(axis=1)):
                q = np.flatnonzero(linked[p])
                need.append((a[at + p, i[q]] + b[at + p, j[q]]).max() - least[at + p])
        rows, margins = np.arange(len(x)), [float(np.quantile(need, recall))] if need else []
        rng = np.random.default_rng(9)
        for part in (slice(None), slice(None, self.cut), slice(self.cut, None)):
            e, y = np.zeros_like(x), x[:, part]
            e[:, part] = rng.normal(size=y.shape)
            size = np.maximum((y * y).sum(axis=1, keepdims=True), 1e-12)
            e[:, part] -= (e[:, part] * y).sum(axis=1, keepdims=True) / size * y
            e /= np.maximum(np.sqrt((e * e).sum(axis=1, keepdims=True)), 1e-12)
            c, d = self.halves(self.similarity * x + np.sqrt(1 - self.similarity**2) * e)
            margins.append(float(np.quantile(a[rows, c.argmin(axis=1)] + b[rows, d.argmin(axis=1)] - least, recall)))
        return 1.15 * max(margins) + 1e-9

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells in the order of the sum of their two distances, up to the bound."""
        oa, ob = np.argsort(a), np.argsort(b)
        sa, sb, n = a[oa], b[ob], len(b)
        bound, heap, out = sa[0] + sb[0] + self.margin, [(sa[0] + sb[0], 0, 0)], []
        while heap:
            s, i, j = heapq.heappop(heap)
            if s > bound:
                break
            out.append(int(oa[i]) * n + int(ob[j]))
            if j + 1 < n:
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(sa):
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
        return out


def build(vectors: DataFrame, n: int, similarity: float, recall: float) -> MultiIndex:
    """An index fitted on the distinct vectors with the smallest hashes. Codebooks grow
    with the number of vectors ``n``, so that a cell of the grid holds about as many as before."""
    centroids = int(np.clip(2 * (n / BLOCK) ** 0.5, 2, CELLS**0.5))
    rows = vectors.orderBy(F.xxhash64("node"), "node").select("vector").limit(max(SAMPLE, 16 * centroids)).toPandas()
    return MultiIndex(unit(np.array(rows["vector"].tolist())), centroids, similarity, recall)


def comparison(similarity: float):
    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Linked weights and links from a partition sorted by block, its own rows first.

        Memory holds one block's own vectors; the asking ones stream past them.
        """
        key, parts, own, mine, weight, root = None, [], None, None, None, None

        def joined(at: np.ndarray) -> list[tuple]:
            """One link to each group of the block that is not joined yet."""
            groups = np.unique(root[at])
            if len(groups) > 1:
                root[np.isin(root, groups)] = groups[0]
            return [(int(mine[groups[0]]), int(mine[g]), 0) for g in groups[1:]]

        def linked(x: np.ndarray, nodes: np.ndarray, n: np.ndarray, asks: bool) -> pd.DataFrame:
            out, got = [], np.zeros(len(mine), np.int64)
            for at in range(0, len(x), 512):
                near = x[at : at + 512] @ own.T >= similarity
                if not asks:
                    near[np.arange(len(near)), at + np.arange(len(near))] = False
                hit = np.flatnonzero(near.any(axis=1))
                if not len(hit):
                    continue
                out += zip(nodes[at + hit].tolist(), [None] * len(hit), (near[hit] @ weight).tolist(), strict=True)
                if asks:
                    got += n[at : at + 512] @ near
                for i in hit.tolist():
                    q = np.flatnonzero(near[i])
                    if asks:
                        out.append((int(nodes[at + i]), int(mine[q[0]]), 0))
                    out += joined(q if asks else np.append(q, at + i))
            hit = np.flatnonzero(got)
            out += zip(mine[hit].tolist(), [None] * len(hit), got[hit].tolist(), strict=True)
            return pd.DataFrame({"a": pd.Series([r[0] for r in out], dtype="int64"), "b": pd.Series([r[1] for r in out], dtype="Int64"), "n": pd.Series([r[2] for r in out], dtype="int64")})

        def closed() -> pd.DataFrame:
            nonlocal parts, own, mine, weight, root
            own, mine, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts, root = [], np.arange(len(mine))
            return linked(own, mine, weight, False)

        for pdf in batches:
            if not len(pdf):
                continue
            cell, block, asks = pdf["cell"].to_numpy(), pdf["block"].to_numpy(), pdf["asks"].to_numpy()
            x, nodes, n = unit(np.array(pdf["vector"].tolist())), pdf["node"].to_numpy(), pdf["n"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
                new = key != (cell[a], block[a])
                if parts and (new or asks[a]):
                    yield closed()
                if new:
                    key, own = (cell[a], block[a]), None
                if not asks[a]:
                    parts.append((x[a:b], nodes[a:b], n[a:b]))
                elif own is not None:
                    yield linked(x[a:b], nodes[a:b], n[a:b], True)
        if parts:
            yield closed()

    return compare


def embedding_links(vectors: DataFrame, similarity: float = 0.9, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """``(node, n)``: weights linked to each node; ``(a, b)``: links joining what is linked.

    ``vectors``: distinct ``node, vector, n``. Within a block only links that merge two
    groups are returned, so large groups don't make all pairs.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vector"].dataType.simpleString()
    n = vectors.count()
    index = build(vectors, n, similarity, recall)
    block = max(BLOCK, -(-4 * n // CELLS))

    def home(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), LOT):
                some = pdf.iloc[at : at + LOT]
                yield some.assign(cell=index.cells(unit(np.array(some["vector"].tolist()))))

    placed = saved(vectors.select("node", "vector", "n").mapInPandas(home, f"node long, vector {kind}, n long, cell long"))
    # at most CELLS rows
    counts = placed.groupBy("cell").count().toPandas()
    index.fill(counts["cell"].to_numpy(), counts["count"].to_numpy(), block)
    sent = spark.sparkContext.broadcast(index)

    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = sent.value
        for pdf in batches:
            for start in range(0, len(pdf), LOT):
                yield from dealt_lot(ix, pdf.iloc[start : start + LOT])

    def dealt_lot(ix: MultiIndex, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, b = ix.halves(unit(np.array(pdf["vector"].tolist())))
        spread = (pdf["node"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        cell = pdf["cell"].to_numpy()
        own = spread % ix.found(cell)[1]
        at, cells, blocks, asks = [], [], [], []
        for k in range(len(pdf)):
            visited = np.array(ix.visits(a[k], b[k]), np.int64)
            others, counts = ix.found(np.append(visited[visited > cell[k]], cell[k]))
            first = np.zeros(len(others), np.int64)
            first[-1] = own[k]  # its own cell: its own block and those behind it
            size = counts - first
            at.append(np.full(size.sum(), k)), cells.append(np.repeat(others, size))
            blocks.append(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size))
            asks.append((cells[-1] != cell[k]) | (blocks[-1] != own[k]))
        at, cells, blocks, asks = (np.concatenate(x) for x in (at, cells, blocks, asks))
        for s in range(0, len(at), 20_000):
            some = pdf.iloc[at[s : s + 20_000]]
            yield pd.DataFrame({"cell": cells[s : s + 20_000], "block": blocks[s : s + 20_000], "asks": asks[s : s + 20_000], "node": some["node"].to_numpy(), "vector": some["vector"].to_numpy(), "n": some["n"].to_numpy()})

    compare = comparison(similarity)
    dealt = placed.mapInPandas(deal, f"cell long, block int, asks boolean, node long, vector {kind}, n long")
    found = saved(dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "asks").mapInPandas(compare, "a long, b long, n long"))
    return found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), found.where("b is not null").select("a", "b")


def near_duplicates(table: DataFrame, id: str = "vec_id", vector: str = "embedding", similarity: float = 0.9, recall: float = 0.999) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing, as do rows without id. Vectors of different lengths have no cosine:
    each length that several vectors have gets an index of its own. Equal vectors are
    compared once and count each, in the column's own precision; ids that repeat stay repeated. An empty table gives
    an empty result. Other columns are not read.
    """
    kind = "array<float>" if table.select(named(vector)).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(named(id).cast("long").alias("id"), named(vector).cast(kind).alias("vector"))
    sound = F.col("id").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False)) & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    distinct = saved(rows.where(sound).groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    none = distinct.select("node", "n").limit(0)
    counts, links = none, none.select(F.col("node").alias("a"), F.col("node").alias("b"))
    for r in distinct.groupBy(F.size("vector").alias("size")).count().where("count > 1").orderBy("size").collect():
        some, joined = embedding_links(distinct.where(F.size("vector") == r["size"]), similarity, recall)
        counts, links = counts.unionByName(some), links.unionByName(joined)
    found = distinct.join(counts.withColumnRenamed("n", "linked"), "node", "left").join(components(links), "node", "left")
    found = found.select("vector", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    out = rows.where(sound).join(found, "vector").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
