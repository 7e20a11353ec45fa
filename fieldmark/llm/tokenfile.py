"""Token ids in a binary format with random access: directly addressable codes.

An id is cut into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of
every id; a continuation bitmap says which ids go on, and level 1 holds the next
chunk of those, and so on. A rank directory (set bits before each block of
``RANK_BLOCK`` bits) leads from a place in one level to its place in the next, so
any id is read by one look per level and no block is decoded.

A stored block is one row: documents in ascending id order, their ids as bytes,
and the end of each document. Blocks lie in Parquet files, since executors share
only what Spark's own readers and writers reach.
"""

from __future__ import annotations

import json
import os
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import named, shared_dir, tidied
from fieldmark.llm.pretokens import Parts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CHUNK, RANK_BLOCK = 8, 512
#: Bytes of results that one worker remembers, also for later tasks, and parts that go to the library together.
MEMO, JOINED = 150 << 20, 5000
#: Ids of a stored block (a longer document has a block of its own), and bytes of text that one task encodes, about.
BLOCK_IDS, RANGE_BYTES = 1 << 20, 64 << 20
BLOCKS = "part int, block int, n_ids long, doc_ids binary, nulls binary, ends binary, codes binary"


class AddressableCodes:
    """Unsigned integers as chunk levels, continuation bitmaps and rank directories."""

    def __init__(self, data: bytes) -> None:
        levels, at = struct.unpack_from("<I", data)[0], 4
        self.chunks, self.bits, self.ranks = [], [], []
        for k in range(levels):
            n = struct.unpack_from("<Q", data, at)[0]
            at += 8
            self.chunks.append(np.frombuffer(data, np.uint8, n, at))
            at += n
            if k + 1 < levels:
                self.bits.append(np.frombuffer(data, np.uint8, -(-n // 8), at))
                at += -(-n // 8)
                self.ranks.append(np.frombuffer(data, "<u4", -(-n // RANK_BLOCK), at))
                at += 4 * -(-n // RANK_BLOCK)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        levels, out = [], []
        while True:
            levels.append((values & np.uint64((1 << CHUNK) - 1)).astype(np.uint8))
            more = values >> np.uint64(CHUNK) != 0
            values = values[more] >> np.uint64(CHUNK)
            if not len(values):
                break
            levels.append(more)
        out.append(struct.pack("<I", (len(levels) + 1) // 2))
        for k, x in enumerate(levels):
            if k % 2 == 0:
                out += [struct.pack("<Q", len(x)), x.tobytes()]
            else:
                starts = np.arange(0, len(x), RANK_BLOCK)
                sums = np.add.reduceat(x, starts, dtype=np.int64)
                out += [np.packbits(x, bitorder="little").tobytes(), (np.cumsum(sums) - sums).astype("<u4").tobytes()]
        return b"".join(out)

    def __len__(self) -> int:
        return len(self.chunks[0])

    def rank(self, level: int, i: int) -> int:
        """Set bits before place ``i`` of a level's continuation bitmap."""
        n = len(self.chunks[level])
        if i >= n and n % RANK_BLOCK == 0:
            b = len(self.ranks[level]) - 1
        else:
            b = i // RANK_BLOCK
        if b < 0:
            return 0
        first = b * RANK_BLOCK
        bits = np.unpackbits(self.bits[level][first // 8 : -(-i // 8)], bitorder="little")[: i - first]
        return int(self.ranks[level][b]) + int(bits.sum())

    def __getitem__(self, i: int) -> int:
        value, level = int(self.chunks[0][i]), 0
        while level < len(self.bits) and self.bits[level][i >> 3] >> (i & 7) & 1:
            i, level = self.rank(level, i), level + 1
            value |= int(self.chunks[level][i]) << (CHUNK * level)
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``, without decoding those before."""
        out = self.chunks[0][start:stop].astype(np.uint64)
        places, level = np.arange(stop - start), 0
        while level < len(self.bits) and stop > start:
            first = start // 8
            more = np.unpackbits(self.bits[level][first : -(-stop // 8)], bitorder="little")[start - 8 * first :][: stop - start].astype(bool)
            start, stop = self.rank(level, start), self.rank(level, stop)
            places, level = places[more], level + 1
            out[places] |= self.chunks[level][start:stop].astype(np.uint64) << np.uint64(CHUNK * level)
        return out


class LibraryEncoder:
    """Whole texts through the tokenizers library, which sees each distinct part of a batch once.

    Texts are cut only where the vocabulary's file asks for the byte-level pattern alone.
    Its added tokens (such as an end mark) are recognised in a text as the library does by
    default; a text that holds one stays in one part.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = json.loads(self.tokenizer.to_str())
        before = form["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not (form["normalizer"] or form["truncation"] or form["padding"] or form["model"].get("dropout"))
        self.joins = plain and not any(set(" \n") & set(t) for t in added)
        self.added, self.parts = added, Parts(self.new, MEMO, plain, added)
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a token has a letter for each byte
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        return self.parts.encode(texts)

    def new(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where those of each part begin and how many they are.

        Parts without white space but a space before them go to the library many in a row, those
        without that space by lines, and their ids are told apart by their bytes; others go one by one.
        """
        rows: dict[str, list[int]] = {"": [], "\n": []}
        single, ids, count = [], [np.empty(0, np.uint32)], 0
        firsts, sizes = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for k, p in enumerate(parts):
            word = p.removeprefix(" ")
            if self.joins and word.split() == [word]:
                rows["" if len(word) < len(p) else "\n"].append(k)
            else:
                single.append(k)
        for sep, these in rows.items():
            for at in range(0, len(these), JOINED):
                some = these[at : at + JOINED]
                row = sep.join([parts[k] for k in some])
                if any(map(row.__contains__, self.added)):
                    single += some
                    continue
                x = self._ids([row])[0]
                n = np.array([len(parts[k].encode()) for k in some])
                begins = np.cumsum(n + len(sep)) - n - len(sep)
                upto = np.append(0, np.cumsum(self.lengths[x]))
                a, b = np.searchsorted(upto, begins), np.searchsorted(upto, begins + n)
                if upto[-1] != begins[-1] + n[-1] or (upto[a] != begins).any() or (upto[b] != begins + n).any():
                    single += some
                    continue
                ids.append(x)
                firsts[some], sizes[some] = count + a, b - a
                count += len(x)
        for at in range(0, len(single), JOINED):
            some = single[at : at + JOINED]
            for k, x in zip(some, self._ids([parts[k] for k in some]), strict=True):
                ids.append(x)
                firsts[k], sizes[k] = count, len(x)
                count += len(x)
        return np.concatenate(ids), firsts, sizes

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", e.ids), np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end_id: int = 0, vocabulary: str = VOCABULARY, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every row's whole text, in ascending id order, to ``path``.

    A null text encodes as an empty one; ``end_id`` follows every document. Null
    ids come first and equal ids stand in the order of their texts. A text of any
    length is encoded whole; an empty table writes no block. Other columns are not
    read. One range shuffle into ranges of about ``RANGE_BYTES`` of text; each task
    writes blocks of at most ``block_ids`` ids or one document.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from tidied(blocks(batches))

    def blocks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block = TaskContext.get().partitionId(), 0
        enc, docs_, ids, size = encoder(vocabulary), [], [], 0
        tail = struct.pack("<I", end_id)

        def flush() -> pd.DataFrame:
            nonlocal block, docs_, ids, size
            numbers = np.array([0 if d is None else d for d in docs_], "<i8")
            nulls = np.packbits(np.array([d is None for d in docs_], bool), bitorder="little")
            ends = np.cumsum([len(x) // 4 for x in ids]).astype("<u8")
            row = (part, block, int(ends[-1]), numbers.tobytes(), nulls.tobytes(), ends.tobytes(), AddressableCodes.pack(np.frombuffer(b"".join(ids), "<u4")))
            block, docs_, ids, size = block + 1, [], [], 0
            return pd.DataFrame([row], columns=["part", "block", "n_ids", "doc_ids", "nulls", "ends", "codes"])

        for pdf in batches:
            keys = [None if gone else int(d) for d, gone in zip(pdf["id"], pdf["none"], strict=True)]
            texts = [t or "" for t in pdf["text"]]
            for d, x in zip(keys, enc.encode(texts), strict=True):
                if size and size + len(x) // 4 + 1 > block_ids:
                    yield flush()
                docs_.append(d)
                ids.append(x + tail)
                size += len(x) // 4 + 1
        if docs_:
            yield flush()

    # a null id travels as a mark beside 0, since Python would read a column with nulls as floats
    key = named(id).cast("long")
    rows = docs.select(key.isNotNull().alias("some"), F.coalesce(key, F.lit(0)).alias("id"), named(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ordered = rows.repartitionByRange(ranges, "some", "id").sortWithinPartitions("some", "id", "text").select("id", (~F.col("some")).alias("none"), "text")
    ordered.mapInPandas(run, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every stored document, from the files alone.

    ``ids``: little-endian 32-bit ids with the end id. ``start``: ids of all
    documents before it. Offsets are sums over blocks, never over documents.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_start"))
    starts = starts.join(firsts, "part").select("part", "block", (F.col("_start") + F.col("_first")).alias("first"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ends = np.frombuffer(row.ends, "<u8").astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                nulls = np.unpackbits(np.frombuffer(row.nulls, np.uint8), bitorder="little")[: len(ends)].astype(bool)
                codes = AddressableCodes(row.codes)
                yield pd.DataFrame({
                    "doc_id": pd.Series(np.frombuffer(row.doc_ids, "<i8")).astype("Int64").mask(nulls), "start": row.first + begins, "n_tokens": ends - begins,
                    "ids": [codes.range(a, b).astype("<u4").tobytes() for a, b in zip(begins, ends, strict=True)],
                })

    # offsets join whole blocks, so that ids never travel
    return blocks.join(starts, ["part", "block"]).mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Write, read back and return ``id, start, n_tokens, ids_crc32`` of every document."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, path, id, text, vocabulary=vocabulary)
    return read_tokens(docs.sparkSession, path).select(F.col("doc_id").alias(id), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
