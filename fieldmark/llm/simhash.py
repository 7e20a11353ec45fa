"""SimHash near-duplicates found with BK-trees.

A fingerprint is the bitwise majority over XXH64 values of word shingles. Links
join fingerprints whose Hamming distance is at most ``radius``. Equal
fingerprints collapse first. Two fingerprints within ``radius`` agree in at least
k of ``radius + k`` bit bands, so the values of each choice of k bands make one shard,
with k chosen so that shards stay small; a shard's
BK-tree (children keyed by their integer Hamming distance to the parent) takes
every fingerprint in turn and a search follows only edges within the radius.
Trees are built where their shard lies: a broadcast would gather the fingerprints
of all documents on the driver, so they are routed by band. A shard with more than
``shard_rows`` fingerprints is dealt into several trees, each of which answers
all fingerprints of that value, so no task holds an unbounded shard.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import Forest, Memo, components, named, saved, small_batches, tidied, without


def simhash(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of UTF-8 bytes; 0 for a text without words.

    A-Z is lower-cased, ASCII white space separates words, shingles repeat, and a
    text of fewer words is one shingle. A bit is 1 if set in over half the hashes.
    """
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    n, digest, join = max(1, len(ws) - words + 1), xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        hashes = np.array([digest(join(ws[i : i + words]), seed) for i in range(at, min(n, at + (1 << 15)))], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` without its text, plus ``fp`` (long), which replaces a column of that name.

    One narrow pass without shuffle, in which only the text goes to Python.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t, words, seed) for t in texts], np.uint64).view(np.int64))

    return docs.select(*without(docs, text, "fp"), run.asNondeterministic()(named(text).cast("binary")).alias("fp"))


class BKTree:
    """Metric tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> int:
        """The node of ``value``, new or not."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while d := (self.values[at] ^ value).bit_count():
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below
        return at

    def nearest(self, value: int, radius: int) -> tuple[int, int] | None:
        """Distance and node of the nearest within ``radius``; of equals the first node."""
        best, stack = None, [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius and (best is None or (d, at) < best):
                best, radius = (d, at), d
            kids = self.children[at]
            if kids:
                stack += [c for k, c in kids.items() if d - radius <= k <= d + radius]
        return best

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Nodes at distance ``radius`` or less."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if kids:
                stack += [c for k, c in kids.items() if d - radius <= k <= d + radius]


def band_keys(n: int, radius: int, crowd: int = 64) -> list[Column]:
    """Keys of ``fp``, of which two fingerprints within ``radius`` share at least one.

    Each key is a choice of k of ``radius + k`` bands, with the least k that leaves, of
    ``n`` fingerprints, about ``crowd`` to a key.
    """
    for together in range(1, 5):
        bands = radius + together
        cuts = [64 * k // bands for k in range(bands + 1)]
        if n >> (64 * together // bands) <= crowd:
            break
    keys = []
    for number, chosen in enumerate(combinations(range(bands), together)):
        key, at = f"bigint({number}) << 48", 0
        for k in chosen:
            width = cuts[k + 1] - cuts[k]
            key, at = f"{key} | (shiftrightunsigned(fp, {cuts[k]}) & {(1 << width) - 1}) << {at}", at + width
        keys.append(F.expr(key))
    return keys


def hamming_links(fps: DataFrame, radius: int = 3, shard_rows: int = 4096) -> DataFrame:
    """``a, b``: links that connect what is within ``radius``.

    ``fps``: distinct ``fp`` with an integer ``node``. Within one tree only links
    that merge two groups are returned (at most one per fingerprint and tree), so
    large groups don't make all pairs; no link between groups is lost.
    """
    keys = band_keys(fps.count(), radius)
    banded = fps.select("node", "fp", F.explode(F.array(*keys)).alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    dealt = banded.join(sizes, "band").withColumn("trees", F.ceil(F.col("n") / shard_rows).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), "trees").cast("int"))
    dealt = dealt.select("band", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), "own", "node", "fp")
    dealt = dealt.select("band", "tree", (F.col("own") != F.col("tree")).alias("asks"), "node", "fp")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, forest, key, nodes = BKTree(), Forest(), None, []
        for pdf in batches:
            links = []
            rows = zip(pdf["band"].tolist(), pdf["tree"].tolist(), pdf["asks"].tolist(), pdf["node"].tolist(), pdf["fp"].to_numpy().view(np.uint64).tolist(), strict=True)
            for band, number, asks, node, fp in rows:
                if key != (band, number):
                    tree, forest, key, nodes = BKTree(), Forest(), (band, number), []
                for other in tree.within(fp, radius):
                    if forest.join(node, nodes[other]):
                        links.append((node, nodes[other]))
                if not asks and tree.insert(fp) == len(nodes):
                    nodes.append(node)
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    # a tree's own rows come first, so that the others find all of them
    return dealt.repartition("band", "tree").sortWithinPartitions("band", "tree", "asks", "node").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``id, fp, component_id`` of every row: the smallest id reachable over links.

    Nulls: a null text has no words (fingerprint 0, linked like any other); a row
    with a null id takes part and gets the component of its fingerprint. Repeated
    rows and ids stay repeated. Long texts are hashed whole. An empty table gives an
    empty result. Columns other than ``id`` and ``text`` are not read.
    """
    rows = saved(fingerprints(docs.select(named(id).cast("long").alias("id"), named(text).alias("text")), words=words))
    distinct = saved(rows.groupBy("fp").agg(F.min("id").alias("node")))
    found = components(hamming_links(distinct.where("node is not null"), radius))
    classes = distinct.join(found, "node", "left").select("fp", F.coalesce("component_id", "node").alias("component_id"))
    return rows.join(classes, "fp").select(F.col("id").alias(id), "fp", "component_id")


#: Bits of a wide fingerprint, and the distance to a tree's nearest one up to which a fingerprint grows no tree.
WIDE, CLOSE = 256, 24
#: Rows of ids up to which a side is broadcast; beyond, both sides are dealt.
FEW = 1_000_000
#: Texts of a block in which a cluster is compared, and their bytes, about.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Bytes of word hashes that one worker remembers during a task.
MEMO = 32 << 20
_MIX = [np.uint64(int(x)) for x in np.random.default_rng(10).integers(1, 1 << 62, WIDE // 64) * 2 + 1]


class WordHashes(Memo):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 40:
            self.keep(word, h)
        return h


def shingle_hashes(text: bytes | None, words: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles (fewer words: of all of them)."""
    ws = (text or b"").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    return np.unique(out)


def wide_simhash(hashes: np.ndarray) -> bytes:
    """``WIDE`` majority bits over the shingles, each hash stretched to that many bits."""
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        h = hashes[at : at + (1 << 14)]
        wide = np.stack([(h ^ h >> np.uint64(31)) * m for m in _MIX], axis=1)
        wide ^= wide >> np.uint64(32)
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def agreement(similarity: float) -> float:
    """Probability that two fingerprints of that Jaccard similarity agree in a bit."""
    return 1 - float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def shingle_prints(docs: DataFrame, text: Column, words: int) -> DataFrame:
    """``docs`` plus ``print``: a wide fingerprint and a 128-bit digest of the shingle set."""

    @F.pandas_udf("fp binary, sig binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordHashes(MEMO)

        def prints(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                h = shingle_hashes(t, words, memo)
                rows.append((wide_simhash(h), xxhash.xxh3_128_digest(h.tobytes())))
            return pd.DataFrame(rows, columns=["fp", "sig"])

        yield from tidied(map(prints, batches), memo)

    return docs.withColumn("print", run.asNondeterministic()(text))


def _nearest_in_trees(radius: int):
    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each row the nearest in its tree so far, from a partition sorted by tree.

        A row close to one of the tree stays outside, so that a group of near copies
        grows no large tree; what it hides is left to the second pass.
        """
        tree, key, nodes = BKTree(), None, []
        for pdf in batches:
            links = []
            for shard, number, node, fp in zip(pdf["shard"].tolist(), pdf["tree"].tolist(), pdf["node"].tolist(), pdf["fp"], strict=True):
                value = int.from_bytes(fp, "little")
                if key != (shard, number):
                    tree, key, nodes = BKTree(), (shard, number), []
                near = tree.nearest(value, radius)
                if near:
                    links.append((node, nodes[near[1]], near[0]))
                if near is None or near[0] > CLOSE:
                    tree.insert(value)
                    nodes.append(node)
            yield pd.DataFrame(links, columns=["a", "b", "d"]).astype({"a": "int64", "b": "int64", "d": "int32"})

    return search


def _candidates_in_trees(radius: int):
    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links that connect what lies within the radius in a tree, from a partition sorted by
        tree, its own rows first. Rows of one root are connected; each link joins two roots."""
        key, kept = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            node, root, own = pdf["node"].to_numpy(), pdf["group"].to_numpy().copy(), ~pdf["asks"].to_numpy()
            shard, tree = pdf["shard"].to_numpy(), pdf["tree"].to_numpy()
            fp = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), -1)
            start = np.concatenate([[True], (shard[1:] != shard[:-1]) | (tree[1:] != tree[:-1])])
            place, first, links = start.cumsum() - 1, np.flatnonzero(start), []
            last = np.append(first[1:], len(pdf))
            if key == (shard[0], tree[0]):  # the tree of the batch before goes on
                nodes, roots, fps = kept
                here = root[: last[0]]
                for i in range(last[0]):
                    hit = np.flatnonzero(roots != here[i])
                    hit = hit[np.bitwise_count(fps[hit] ^ fp[i]).sum(axis=1) <= radius]
                    for r, j in zip(*np.unique(roots[hit], return_index=True), strict=True):
                        links.append((node[i], nodes[hit[j]]))
                        label = here[i]
                        roots[roots == r] = label
                        here[here == r] = label
            live, k = np.flatnonzero(own), 1
            while len(live := live[live + k < len(pdf)]) and len(live := live[place[live] == place[live + k]]):
                i = live[root[live] != root[live + k]]
                i = i[np.bitwise_count(fp[i] ^ fp[i + k]).sum(axis=1) <= radius]
                for x in i.tolist():
                    if root[x] != root[x + k]:
                        links.append((node[x], node[x + k]))
                        here = root[first[place[x]] : last[place[x]]]
                        here[here == root[x + k]] = root[x]
                k += 1
            mine = own & (place == place[-1])
            mine = node[mine], root[mine], fp[mine]
            same, key = key == (shard[-1], tree[-1]), (shard[-1], tree[-1])
            kept = tuple(np.concatenate(x) for x in zip(kept, mine, strict=True)) if same else mine
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return search


class ShingleBlock:
    """Shingle sets of some texts, and for each shingle the texts that hold it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        flat, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.texts = text[order]

    def similar(self, own: np.ndarray, similarity: float) -> np.ndarray:
        """Places of the texts whose Jaccard similarity to a set is ``similarity`` or more."""
        if not len(own):
            return np.flatnonzero(self.sizes == 0)
        at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1) if len(self.shingles) else np.zeros(0, np.int64)
        at = at[self.shingles[at] == own] if len(at) else at
        n = self.count[at]
        held = self.texts[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both = np.bincount(held, minlength=len(self.sizes))
        return np.flatnonzero(both >= similarity * (len(own) + self.sizes - both))


def _similar_in_blocks(words: int, similarity: float):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links between groups of similar texts, from a partition sorted by block, its own rows
        first. Memory holds one block's own sets; the asking rows stream past them, and each
        link joins two groups, so that no pairs pile up."""
        key, parts, block, nodes, roots = None, [], None, None, None
        memo = WordHashes(MEMO)

        def links_of(rows: Iterable[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
            found = []
            for node, group, own in rows:
                hit = block.similar(own, similarity)
                mine = np.flatnonzero(nodes == node)
                label = roots[mine[0]] if len(mine) else group
                hit = hit[roots[hit] != label]
                for r, j in zip(*np.unique(roots[hit], return_index=True), strict=True):
                    found.append((node, nodes[hit[j]]))
                    roots[roots == r] = label
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        def closed() -> pd.DataFrame:
            nonlocal block, nodes, roots, parts
            nodes, roots, block = np.array([x[0] for x in parts]), np.array([x[1] for x in parts]), ShingleBlock([x[2] for x in parts])
            rows, parts = parts, []
            return links_of(rows)

        def found() -> Iterator[pd.DataFrame]:
            nonlocal key, block
            for pdf in batches:
                asking = []
                for c, b, asks, node, group, text in zip(pdf["cluster"], pdf["block"], pdf["asks"], pdf["node"], pdf["group"], pdf["text"], strict=True):
                    new = key != (c, b)
                    if asking and new:
                        yield links_of(asking)
                        asking = []
                    if parts and (new or asks):
                        yield closed()
                    if new:
                        key, block = (c, b), None
                    row = node, group, shingle_hashes(text, words, memo)
                    if not asks:
                        parts.append(row)
                    elif block is not None:
                        asking.append(row)
                if asking:
                    yield links_of(asking)
            if parts:
                yield closed()

        yield from tidied(found(), memo)

    return run


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.95, shard_rows: int = 4096) -> DataFrame:
    """``id, component_id`` of every row: the smallest id reachable over links of texts
    whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Texts of equal shingle sets collapse first. Wide fingerprints are dealt by several
    choices of their bits; each shard's BK-tree finds what lies within the distance that
    similar texts keep. The number of bits follows the number of fingerprints and the
    number of choices follows ``recall``, so shards stay small. Every link is verified on
    the whole texts: first that of each text to the nearest one found; then what lies within
    the distance without being joined is connected to clusters, and each cluster's texts are
    compared whole, so that no group hides a partner and no pairs travel. A crowded shard is
    dealt into trees and a large cluster into blocks; the rows of its largest group stay in
    one each and the others visit all.

    Texts without words are alike. Nulls, repeated rows, long texts and empty tables are
    as in ``near_duplicates``; rows of null ids get the component of an equal shingle set,
    if it has an id.
    """
    small_batches(docs.sparkSession)
    p = agreement(similarity)
    radius = int(WIDE * (1 - p) + 2.5 * (WIDE * p * (1 - p)) ** 0.5)
    source = docs.select(named(id).cast("long").alias("id"), named(text).cast("binary").alias("text"))
    rows = saved(shingle_prints(source, F.col("text"), words).select("id", "print.fp", "print.sig"))
    distinct = saved(rows.groupBy("sig").agg(F.min("id").alias("node"), F.min("fp").alias("fp")).where("node is not null"))
    n = distinct.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 2))) - 2, 12, 32))
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - p**bits)))
    picks = np.stack([np.random.default_rng(100 + k).choice(WIDE, bits, replace=False) for k in range(tables)])

    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for pdf in batches:
            others = [c for c in pdf.columns if c != "fp"]
            for at in range(0, len(pdf), 1000):
                some = pdf.iloc[at : at + 1000]
                if len(some):
                    flat = np.unpackbits(np.frombuffer(b"".join(some["fp"]), np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
                    keys = flat[:, picks].astype(np.int64) @ weights | np.arange(tables, dtype=np.int64) << 32
                    yield pd.DataFrame({"shard": keys.ravel(), **{c: np.repeat(some[c].to_numpy(), tables) for c in others}, "fp": np.repeat(some["fp"].to_numpy(), tables)})

    dealt = distinct.select("node", "fp").mapInPandas(deal, "shard long, node long, fp binary")
    crowded = saved(dealt.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("trees")))
    n_crowded = crowded.count()

    def small(frame: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(frame) if rows <= FEW else frame

    def in_trees(dealt: DataFrame, crowded: DataFrame) -> DataFrame:
        """Each row with its own tree; trees differ from shard to shard."""
        if not n_crowded:
            return dealt.withColumn("trees", F.lit(1)).withColumn("own", F.lit(0)).withColumn("top", F.lit(None).cast("long"))
        dealt = dealt.join(small(crowded, n_crowded), "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
        return dealt.withColumn("own", F.pmod(F.xxhash64("node", "shard"), "trees").cast("int"))

    first = in_trees(dealt, crowded).select("shard", F.col("own").alias("tree"), "node", "fp")
    first = first.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "node")
    found = first.mapInPandas(_nearest_in_trees(radius), "a long, b long, d int")
    found = found.select(F.greatest("a", "b").alias("a"), F.struct("d", F.least("a", "b").alias("b")).alias("near"))
    tried = saved(found.groupBy("a").agg(F.min("near").alias("near")).select("a", "near.b"))

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole texts are similar."""
        ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        texts = saved(source.join(small(ids, ids.count()), "id").groupBy("id").agg(F.min("text").alias("text")))
        pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return pairs.mapInPandas(verify, "a long, b long")

    def verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes(MEMO)

        def similar(pdf: pd.DataFrame) -> pd.DataFrame:
            keep = []
            a = b = None
            for i, j, x, y in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                if i != a:
                    a, s = i, shingle_hashes(x, words, memo)
                if j != b:
                    b, t = j, shingle_hashes(y, words, memo)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(t) - both))
            return pdf.loc[keep, ["a", "b"]]

        yield from tidied(map(similar, batches), memo)

    links = saved(checked(tried))
    groups = components(links)
    grouped = saved(distinct.join(groups, "node", "left").select("node", F.coalesce("component_id", "node").alias("group"), "fp"))
    again = grouped.mapInPandas(deal, "shard long, node long, group long, fp binary")
    if n_crowded:
        tops = again.join(small(crowded, n_crowded), "shard").groupBy("shard", "group", "trees").count().groupBy("shard", "trees").agg(F.max_by("group", F.struct("count", "group")).alias("top"))
        crowded = saved(tops)
    again = in_trees(again, crowded)
    last = F.col("trees") - 1
    visits = F.when(F.col("trees") == 1, F.array(F.lit(0))).when(F.col("group") == F.col("top"), F.array("own")).otherwise(F.sequence(F.lit(0), last))
    again = again.withColumn("tree", F.explode(visits)).select("shard", "tree", "node", "group", "fp", (F.col("own") != F.col("tree")).alias("asks"))
    again = again.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "asks").mapInPandas(_candidates_in_trees(radius), "a long, b long")
    again = saved(again.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if again.limit(1).count():
        links = links.unionByName(_between_groups(source, grouped, links, again, words, similarity))
        groups = components(links)
    classes = distinct.join(groups, "node", "left").select("sig", F.coalesce("component_id", "node").alias("component_id"))
    return rows.join(classes, "sig", "left").select(F.col("id").alias(id), "component_id")


def _between_groups(source: DataFrame, grouped: DataFrame, links: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """Verified links between groups of one cluster: what links and candidates connect.

    Each cluster's texts are compared whole, in blocks of bounded numbers and bytes. The
    largest group's texts stay in a block each and the others visit all blocks.
    """
    clusters = saved(components(links.unionByName(candidates)).withColumnRenamed("component_id", "cluster"))
    # ``a``, the larger id, is never the smallest of its cluster, which the components leave out
    open_ = candidates.join(clusters.withColumnRenamed("node", "a"), "a").select("cluster").distinct()
    nodes = clusters.join(open_, "cluster", "left_semi").select("cluster", "node").unionByName(open_.select("cluster", F.col("cluster").alias("node"))).distinct()
    nodes = saved(nodes.join(grouped.select("node", "group"), "node"))
    few = nodes.count() <= FEW
    texts = source.join(F.broadcast(nodes) if few else nodes, F.col("id") == F.col("node")).groupBy("cluster", "group", "node").agg(F.min("text").alias("text"))
    texts = saved(texts)
    groups = texts.groupBy("cluster", "group").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = groups.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"), F.max_by("group", F.struct("n", "group")).alias("top"))
    dealt = texts.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    visits = F.when(F.col("group") == F.col("top"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("block", F.explode(visits)).select("cluster", "block", (F.col("own") != F.col("block")).alias("asks"), "node", "group", "text")
    return saved(dealt.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "asks").mapInPandas(_similar_in_blocks(words, similarity), "a long, b long"))
