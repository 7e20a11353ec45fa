"""Many words looked for at once in many texts.

The words go into one automaton (Aho and Corasick), which reads each character of a text once
however many words there are, of any length and script. An automaton is broadcast; its words
are counted and measured first, and a larger set is dealt to several automata, each of which
passes over the texts in turn, so that no set is too large.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fieldmark.functions.columns import col

#: Characters of all words of one automaton, at most: it takes up to about 100 bytes for each.
MOST_CHARACTERS = 2_000_000


def automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in words:
        if w:
            found.add_word(w, w)
    found.make_automaton()
    return found


def spans(found: ahocorasick.Automaton, text: str) -> list[tuple[int, int]]:
    """Begin and end of the words in ``text`` from left to right, the longest of those that begin
    at one place; none overlap."""
    if not len(found):
        return []
    longest: dict[int, int] = {}
    for last, word in found.iter(text):
        longest[last - len(word) + 1] = last + 1  # of one begin, longer words end later
    out, at = [], 0
    for begin in sorted(longest):
        if begin >= at:
            at = longest[begin]
            out.append((begin, at))
    return out


def put_in(found: ahocorasick.Automaton, new: dict[str, str], text: str) -> str:
    """``text`` with its words replaced; what was put in is not looked at again."""
    parts, at = [], 0
    for begin, end in spans(found, text):
        parts += text[at:begin], new[text[begin:end]]
        at = end
    return "".join([*parts, text[at:]]) if parts else text


def lots(words: DataFrame, word: str = "word") -> Iterator[list[str]]:
    """The distinct words in lots that one automaton holds."""
    rows = words.select(col(word).cast("string").alias("w")).where("w <> ''").distinct()
    size = rows.agg(F.sum(F.length("w"))).first()[0] or 0
    n = -(-2 * size // MOST_CHARACTERS) if size > MOST_CHARACTERS else 1
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("w"), F.lit(n)) == k)
        # at most about half of MOST_CHARACTERS where there are several lots, since hashes deal evenly
        yield sorted(own.toPandas()["w"])


def occurrences(texts: DataFrame, words: DataFrame, keys: list[str], text: str = "text", word: str = "word") -> DataFrame:
    """``keys, word, n``: how often each text holds each word, overlaps included.

    Null and empty texts hold none; words may be of any length and script and may repeat.
    """
    spark = texts.sparkSession
    rows = texts.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], col(text).alias("text")).where("text <> ''")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["word string", "n long"])
    out = None
    for some in lots(words, word):
        sent = spark.sparkContext.broadcast(automaton(some))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = sent.value
            for batch in batches:
                counts = [Counter(w for _, w in found.iter(t)) if len(found) else {} for t in batch.column("text").to_pylist()]
                of = pa.array([i for i, c in enumerate(counts) for _ in c], pa.int64())
                held = [batch.column(k).take(of) for k in range(batch.num_columns - 1)]
                new = [pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays([*held, *new], names=[*batch.schema.names[:-1], "word", "n"])

        got = rows.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out.toDF(*keys, "word", "n")


def replaced_in(texts: DataFrame, new: dict[str, str], text: str = "text", count: str | None = None) -> DataFrame:
    """``texts`` with each word of ``new`` replaced, in one pass over each text; a set of rules has
    at most ``MOST_CHARACTERS``. ``count`` names an added column: replaced places."""
    if sum(map(len, new)) > MOST_CHARACTERS:
        raise ValueError(f"rules of more than {MOST_CHARACTERS} characters")
    sent = texts.sparkSession.sparkContext.broadcast((automaton(new), dict(new)))

    @F.pandas_udf("text string, n long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found, by = sent.value
        for batch in batches:
            yield pd.DataFrame({"text": [t if t is None else put_in(found, by, t) for t in batch], "n": [0 if t is None else sum(by[t[a:b]] != t[a:b] for a, b in spans(found, t)) for t in batch]})

    got = texts.withColumn("_got", run(col(text)))
    return got.withColumns({text: F.col("_got.text")} | ({count: F.col("_got.n")} if count else {})).drop("_got")


@F.pandas_udf(StringType())
def replaced_each(text: pd.Series, words: pd.Series, new: pd.Series) -> pd.Series:
    """Each text with its own words replaced by its own new ones; null words leave it as it is."""
    out = []
    for t, ws, by in zip(text, words, new, strict=True):
        if t is None or ws is None or not len(ws):
            out.append(t)
        else:
            out.append(put_in(automaton(ws), dict(zip(ws, by, strict=True)), t))
    return pd.Series(out, dtype=object)
