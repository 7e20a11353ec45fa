"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
token as it stands is resolved by one probe and one comparison. Tier two merges
the rest: bytes in a linked list, candidate pairs in a heap, lowest rank first.
Texts of a batch are cut into parts, of which each distinct one is encoded once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import named, small_batches, tidied, without
from fieldmark.llm.pretokens import Parts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: White space as Unicode's property has it; Python's own \s also takes U+001C to U+001F.
PATTERN = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
#: Bytes of results that one worker remembers, also for later tasks.
MEMO = 100 << 20


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: hash, displace, compare.

    Keys fall into buckets; a bucket of several keys gets the first displacement
    that sends all of them to free slots, and single keys get the slots left over.
    Displacements repeat after as many tries as there are slots: a bucket that finds
    none by then makes all keys be hashed anew with the next seed.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        if len(set(keys)) < n:
            raise ValueError("keys must be distinct")
        self.n, self.buckets, self.seed = n, max(1, n // 3), 0
        while not self._placed(keys):
            self.seed += 1

    def _placed(self, keys: list[bytes]) -> bool:
        n = self.n
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key, self.seed)
            groups.setdefault(h % self.buckets, []).append((h >> 32 & 0xFFFFFFFF, h >> 64 | 1, i))
        self.shift, self.slots = [0] * self.buckets, [-1] * n
        free = n - 1
        for b, group in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(group) > 1:
                for d in range(n):
                    places = [(x + d * y) % n for x, y, _ in group]
                    if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                        break
                else:
                    return False
                self.shift[b] = d
                for p, (_, _, i) in zip(places, group, strict=True):
                    self.slots[p] = i
            else:
                while self.slots[free] >= 0:
                    free -= 1
                self.shift[b], self.slots[free] = -1 - free, group[0][2]
        return True

    def slot(self, key: bytes) -> int:
        """The number of the only key that this can be; -1 for none."""
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        return self.slots[-1 - d if d < 0 else ((h >> 32 & 0xFFFFFFFF) + d * (h >> 64 | 1)) % self.n]


class BytePairCodec:
    """Encodes and decodes by a rank file, without special tokens."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = list(self.ranks)
        self.ids = list(self.ranks.values())
        self.hash = PerfectHash(self.tokens)
        self.pattern = regex.compile(pattern)
        self.parts = Parts(self.new, MEMO, pattern == PATTERN)
        size = max(self.ids) + 1
        lengths = np.zeros(size, np.int64)
        for token, i in self.ranks.items():
            lengths[i] = len(token)
        by_id = sorted(self.ranks, key=self.ranks.get)
        self.lengths, self.flat = lengths, np.frombuffer(b"".join(by_id), np.uint8)
        self.starts = np.cumsum(lengths) - lengths

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: repeated merges of the adjacent pair of the lowest rank, leftmost first."""
        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = after.copy()
        alive = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or ranks.get(piece[i : end[j]]) != r:
                continue
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (q, i))
            if (p := before[i]) >= 0 and (q := ranks.get(piece[p : end[i]])) is not None:
                heapq.heappush(heap, (q, p))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def pieces(self, text: str) -> list[int]:
        """Ids of a text by its pre-tokens."""
        out: list[int] = []
        for piece in self.pattern.findall(text):
            key = piece.encode()
            k = self.hash.slot(key)
            if k >= 0 and self.tokens[k] == key:
                out.append(self.ids[k])
            else:
                out += self.merge(key)
        return out

    def new(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts in a row, where those of each part begin and how many they are."""
        ids, ends = array("I"), []
        for part in parts:
            ids.extend(self.pieces(part))
            ends.append(len(ids))
        upto = np.array([0, *ends], np.int64)
        return np.frombuffer(ids, np.uint32), upto[:-1], np.diff(upto)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        return next(self.parts.encode([text]))

    def decode(self, ids: bytes) -> bytes:
        """The bytes behind little-endian 32-bit ids."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for k in range(0, len(at), 1 << 18):
            part = at[k : k + (1 << 18)]
            n = self.lengths[part]
            places = np.repeat(self.starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(self.flat[places].tobytes())
        return b"".join(out)


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str = RANKS, memo: int = MEMO) -> BytePairCodec:
    """One codec per worker process and rank file, which remembers ``memo`` bytes of results."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    if _codecs[path].parts.memo.limit != memo:
        _codecs[path].parts.clear(memo)
    return _codecs[path]


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", path: str = RANKS, memo: int = MEMO) -> DataFrame:
    """``docs`` without its text, plus ``ids``: binary, little-endian 32-bit ids.

    A null text encodes as an empty one; a text of any length is encoded whole, in memory
    that grows with it. Rows may repeat; an empty table gives an empty result. A column
    that has the name of ``ids`` is replaced, all others stay. One narrow pass, in which
    only the text goes to Python. Each worker remembers ``memo`` bytes of results.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, memo)
        yield from tidied(pd.Series(list(c.parts.encode([t or "" for t in texts])), dtype=object) for texts in batches)

    return docs.select(*without(docs, text, ids), run.asNondeterministic()(named(text)).alias(ids))


def decode(tokens: DataFrame, ids: str = "token_ids", out: str = "decoded", path: str = RANKS) -> DataFrame:
    """``tokens`` without ``ids``, plus ``out``: the decoded bytes (null ids: null).

    A column that has the name of ``out`` is replaced, all others stay.
    """

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        yield from tidied(pd.Series([None if x is None else c.decode(x) for x in some], dtype=object) for some in batches)

    return tokens.select(*without(tokens, ids, out), run.asNondeterministic()(named(ids)).alias(out))


def round_trip(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    Encoding, decoding and both digests in one pass, so that neither ids nor
    decoded bytes travel. Nulls and empty texts have no tokens; ids may be null or
    repeat; long texts are encoded whole; other columns are not read.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)

        def digests(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for x in c.parts.encode([t or "" for t in texts]):
                rows.append((len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(c.decode(x)).hexdigest()))
            return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        yield from tidied(map(digests, batches))

    found = docs.select(named(id).alias("_id"), run.asNondeterministic()(named(text)).alias("_of"))
    return found.select(F.col("_id").alias(id), "_of.*")
