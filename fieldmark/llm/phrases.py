"""Phrase collocations by Apriori's level-wise passes.

Level 1 counts all words. Level k counts phrases of k words, but only where both
overlapping phrases of k - 1 words are frequent, which each task knows from a broadcast
of the level before. Only counts leave a task, one row for each distinct phrase it has met.
Scores are then taken from the level tables: every cut of a phrase into two is in them, since a
part of a frequent phrase is frequent.

What is broadcast are 64-bit hashes of frequent phrases, up to ``MOST`` of them, and beyond
that a bitmap of fixed size. A collision lets a phrase be counted that need not be; it never
changes a count, as phrases are counted and compared by their words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import named, saved, small_batches

#: Hashes broadcast one by one, at most (32 MB); bits of the bitmap beyond that (32 MB).
MOST, BITS = 4_000_000, 28
#: Words of 64 bits in a page of the bitmap, as it comes to the driver (64 KB).
PAGE = 1 << 13
#: Bytes of text cut into words at once; distinct words and phrases that a task holds before it sends their counts.
LOT, WORDS, PHRASES = 1 << 20, 400_000, 1_500_000
LONGEST = 4
#: Parts that a language's candidates are dealt to before its best are chosen.
PARTS = 64

#: A-Z become small, tabs blanks, and marks between pieces a full stop, which no word can hold.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if bytes([b]) in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
BREAK = b"."


def lots(text: bytes) -> Iterator[list[bytes]]:
    """The text's words in turn, a full stop at each break between pieces."""
    text = text.translate(TABLE)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + LOT)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(BREAK, b" . ").split()
        at = end


def follow(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases one word longer."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    return h ^ (h >> np.uint64(32))


def start(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang, seed=1))


class Frequent:
    """Which phrases of the level before are frequent."""

    def __init__(self, hashes: np.ndarray | None = None, bitmap: np.ndarray | None = None) -> None:
        self.hashes, self.bitmap = hashes, bitmap

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.bitmap is not None:
            at = h >> np.uint64(64 - BITS)
            return (self.bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h


class Ids(dict):
    """Numbers of words in order of appearance, and their hashes; 0 is the break."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})
        self.words, self.hashes = [BREAK], np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.words)
        self.words.append(word)
        if i == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(i, np.uint64)])
        self.hashes[i] = xxhash.xxh64_intdigest(word)
        return i


class Tally:
    """Exact counts of phrases given as numbers of words, two to a column."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, words: list[np.ndarray]) -> None:
        w = [x.astype(np.int64) for x in words] + [np.zeros(len(words[0]), np.int64)] * (LONGEST - len(words))
        self.parts.append(self._merged(w[0] << 32 | w[1], w[2] << 32 | w[3], np.ones(len(w[0]), np.int64)))
        self.size += len(self.parts[-1][0])
        if len(self.parts) > 32:
            self.merge()

    @staticmethod
    def _merged(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(a):
            return a, b, n
        order = np.lexsort((b, a)) if b.any() else np.argsort(a, kind="stable")
        a, b, n = a[order], b[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[new], b[new], np.add.reduceat(n, new)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [self._merged(*map(np.concatenate, zip(*self.parts, strict=True)))]
        self.size = len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 3


def _rows(tallies: dict[str, Tally], ids: Ids, k: int) -> Iterator[pa.RecordBatch]:
    for lang, tally in tallies.items():
        a, b, n = tally.merge()
        for at in range(0, len(n), 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            columns = [(c >> s & 0xFFFFFFFF).tolist() for c, s in ((x, 32), (x, 0), (y, 32), (y, 0))][:k]
            words = [[ids.words[i] for i in c] for c in columns]
            grams = list(map(b" ".join, zip(*words, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams, pa.binary()).cast(pa.string()), n[at : at + 100_000]], names=["lang", "phrase", "f"])


def _joined(batch: pa.RecordBatch) -> dict[str, bytes]:
    """Each language's texts end to end, with a line break between two, which ends a piece."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        if text.is_valid:
            texts.setdefault(lang, []).append(text.as_buffer().to_pybytes())
    return {lang: b"\n".join(own) for lang, own in texts.items()}


def counted_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, by language, and a row without phrase for all words."""
    counts: dict[str, Counter] = {}
    totals: Counter[str] = Counter()

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(BREAK, None)
            words, n = list(own), list(own.values())
            for at in range(0, len(n), 100_000):
                some = words[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array(n[at : at + 100_000], pa.int64())], names=["lang", "phrase", "f"])
        counts.clear()

    for batch in batches:
        for lang, text in _joined(batch).items():
            for words in lots(text):
                totals[lang] += len(words) - words.count(BREAK)
                counts.setdefault(lang, Counter()).update(words)
                if sum(map(len, counts.values())) > WORDS:
                    yield from sent()
    yield from sent()
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([None] * len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "phrase", "f"])


def counted(k: int, known: Frequent, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of ``k`` words (2 or more) with their counts, by language.

    Texts are cut in lots, and the last ``k - 1`` words of a lot go before the next one.
    """
    ids, tallies, flags = Ids(), {}, {}
    for batch in batches:
        for lang, text in _joined(batch).items():
            first, carry = start(lang), np.zeros(0, np.int64)
            for words in lots(text):
                new = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                w = np.concatenate([carry, new])
                carry = w[max(len(w) - k + 1, 0) :]
                if len(w) < k:
                    continue
                if k == 2:  # each word is asked for once
                    done = flags.get(lang, np.zeros(1, bool))
                    if len(done) < len(ids.words):
                        more = ids.hashes[len(done) : len(ids.words)]
                        done = flags[lang] = np.concatenate([done, known.has(follow(np.full(len(more), first), more))])
                    inside = done[w]
                else:
                    h, inside = np.full(len(w) - k + 2, first), np.ones(len(w) - k + 2, bool)
                    for j in range(k - 1):
                        part = w[j : j + len(h)]
                        h, inside = follow(h, ids.hashes[part]), inside & (part > 0)
                    inside[inside] = known.has(h[inside])
                at = np.flatnonzero(inside[:-1] & inside[1:])
                if len(at):
                    tallies.setdefault(lang, Tally()).add([w[at + j] for j in range(k)])
                if len(ids.words) > WORDS or sum(t.size for t in tallies.values()) > PHRASES:
                    merged = sum(len(t.merge()[0]) for t in tallies.values())
                    if len(ids.words) > WORDS or merged > PHRASES // 2:
                        yield from _rows(tallies, ids, k)
                        left = [ids.words[i] for i in carry]
                        ids, tallies, flags = Ids(), {}, {}
                        carry = np.array([ids[w] for w in left], np.int64)
    yield from _rows(tallies, ids, k)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    starts, known = {}, {}
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        words = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
        langs = batch.column("lang").to_pylist()
        starts.update((x, start(x)) for x in set(langs) - starts.keys())
        if len(known) > WORDS:
            known.clear()
        known.update((x, xxhash.xxh64_intdigest(x)) for x in {x for w in words for x in w} - known.keys())
        h = np.array([starts[x] for x in langs], np.uint64)
        for j in range(max(map(len, words), default=0)):
            h = follow(h, np.array([known[w[j]] for w in words], np.uint64))
            out = h
        yield pa.RecordBatch.from_arrays([out.view(np.int64)], names=["h"])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes end to end, a row for each batch: the driver sees no row of a single hash."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("h").to_numpy().tobytes()], pa.binary())], names=["bytes"])


def _page(words: pd.DataFrame) -> pd.DataFrame:
    """One page of the bitmap from those of its words that have bits."""
    out, at = np.zeros(PAGE, np.int64), words["i"].to_numpy()
    out[at % PAGE] = words["bits"].to_numpy()
    return pd.DataFrame({"page": [at[0] // PAGE], "bytes": [out.tobytes()]})


def frequent(level: DataFrame) -> Frequent:
    """What tasks need to know of a level: at most ``MOST`` hashes, or a bitmap of ``BITS`` bits.

    Either comes to the driver as bytes, 32 MB at most; rows would take many times that.
    """
    hashes = level.select("lang", "phrase").mapInArrow(_hashed, "h long")
    if level.count() <= MOST:
        parts = hashes.mapInArrow(_packed, "bytes binary").toArrow().column("bytes")
        found = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in parts)])
        found.sort()
        return Frequent(found)
    at = F.shiftrightunsigned("h", 64 - BITS)
    words = hashes.select(F.shiftright(at, 6).alias("i"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - BITS}) & 63))").alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("bits"))
    pages = words.groupBy(F.expr(f"i div {PAGE}")).applyInPandas(_page, "page long, bytes binary").toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    for page, own in zip(pages.column("page").to_pylist(), pages.column("bytes"), strict=True):
        bitmap[page * PAGE : (page + 1) * PAGE] = np.frombuffer(own.as_buffer(), np.uint64)
    return Frequent(bitmap=bitmap)


def levels(docs: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (``lang, n``) and its frequent phrases of 1 to 4 words (``lang, phrase, f``)."""
    spark, out, known, totals = docs.sparkSession, [], None, None
    small_batches(spark)
    for k in range(1, LONGEST + 1):
        sent = spark.sparkContext.broadcast(known)
        count = counted_words if k == 1 else lambda batches, k=k, sent=sent: counted(k, sent.value, batches)
        counts = docs.mapInArrow(count, "lang string, phrase string, f long")
        level = saved(counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(f"f >= {least} or phrase is null"))
        sent.destroy()  # the level is written; what its tasks knew goes before the next is gathered
        known = sent = count = None
        if k == 1:
            totals = level.where("phrase is null").select("lang", F.col("f").alias("n"))
            level = level.where("phrase is not null")
        out.append(level)
        if k < LONGEST:
            known = frequent(level)
    return totals, out


def mine(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to 4 words.

    ``a`` counts a phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` the language's words; ``score``
    is ``2000000 * a / (l + r)``, rounded down. Phrases counted fewer than ``least`` times are left
    out, and so is one that lies inside a longer one counted at least ``covered`` hundredths as
    often. Better scores come first, then larger counts, then phrases by their bytes.

    A null language is ``und``; a null or empty text has no words, and a text of breaks has none
    either. Texts of any length are read whole. Repeated rows count each time; further columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).alias("lang"), named(text).alias("text")).where("text <> ''")
    totals, tables = levels(docs, least)
    known = tables[0]
    for t in tables[1:]:
        known = known.unionByName(t)
    longer = tables[1].unionByName(tables[2]).unionByName(tables[3]).withColumn("w", F.split("phrase", " ", -1))

    def part(begin: str, size: str) -> str:
        return f"array_join(slice(w, {begin}, {size}), ' ')"

    cuts = longer.selectExpr("lang", "phrase", "f as a", "w", "explode(sequence(1, size(w) - 1)) as k")
    cuts = cuts.selectExpr("lang", "phrase", "a", "k", f"{part('1', 'k')} as head", f"{part('k + 1', 'size(w) - k')} as tail")
    cuts = cuts.join(known.selectExpr("lang", "phrase as head", "f as l"), ["lang", "head"]).join(known.selectExpr("lang", "phrase as tail", "f as r"), ["lang", "tail"])
    # sums and products of longs as decimals: nothing overflows
    score = "cast(2000000BD * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as bigint)"
    best = cuts.withColumn("score", F.expr(score)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    spans = longer.where("size(w) > 2").selectExpr("lang", "f", "w", "explode(sequence(2, size(w) - 1)) as m").selectExpr("lang", "f", "w", "m", "explode(sequence(1, size(w) - m + 1)) as b")
    inside = spans.selectExpr("lang", f"{part('b', 'm')} as phrase", "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(f"most is null or 100BD * cast(most as decimal(19, 0)) < {covered}BD * cast(a as decimal(19, 0))")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
