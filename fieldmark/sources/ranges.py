"""Text files read by byte ranges: encodings, line numbers and quoted records.

A range begins at a line, but a line may lie inside quotes that were opened ranges ago. So
each range is scanned once for both possibilities: where it leads from outside quotes and
where from inside. Composing these over the ranges of a file tells each range how it
begins; the same scan finds the encoding and the number of lines before it. In the
second pass every range cuts its own records, and only the ends that cross a border are
joined. A file of any size is read by as many tasks as it has ranges.

No byte of a character of UTF-8 or GB18030 beside ASCII itself is a quote, a line break, a
tab, a comma or a semicolon, so files are cut before they are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.sources.shared import written

#: Ranges whose marks are broadcast; beyond, they are joined by a shuffle.
MOST_RANGES = 100_000
#: Bytes of a record: beyond, a quote was never closed.
MOST_RECORD = 256 << 20
WHOLE, HEAD, TAIL, MIDDLE, HEADER = range(5)
KEY = ["path", "start", "size"]
BOM = b"\xef\xbb\xbf"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, start, size, line``: every line's bytes, in file order within its range."""
    # else another number of cores between two passes would cut the files anew
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    meta = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "path"), ("file_block_start", "start"), ("file_block_length", "size"))]
    return spark.read.option("lineSep", "\n").text(path).select(*meta, F.col("value").cast("binary").alias("line"))


def splitter(sep: bytes) -> Callable[[bytes, bool], bool]:
    """A function that tells whether quotes are open at the end of a line, from whether they
    were at its begin. Quotes open only at the begin of a field, blanks aside; a quote
    inside is written twice; after the closing one the field goes on to the next separator."""
    opening = re.compile(rb'(?:^|%s)[ ]*"' % re.escape(sep))

    def ends(line: bytes, inside: bool) -> bool:
        if b'"' not in line:
            return inside
        at = 0
        while True:
            if inside:
                at = line.find(b'"', at)
                while at >= 0 and line[at + 1 : at + 2] == b'"':
                    at = line.find(b'"', at + 2)
                if at < 0:
                    return True
                at = line.find(sep, at + 1)
                if at < 0:
                    return False
            found = opening.search(line, at)
            if not found:
                return False
            at, inside = found.end(), True

    return ends


def pieces(line: bytes) -> list[tuple[bytes, bytes]]:
    """A line and its end; single carriage returns end lines too."""
    if b"\r" not in line:
        return [(line, b"\n")]
    *first, last = line.removesuffix(b"\r").split(b"\r")
    return [*((x, b"\r") for x in first), (last, b"\r\n" if line.endswith(b"\r") else b"\n")]


def _decodes(text: bytes, encoding: str) -> bool:
    try:
        text.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _ranges(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """Values of ``columns`` and lines of each stretch of one range."""
    for batch in batches:
        found = batch.column("line").to_pylist()
        marks = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        at = 0
        for k in range(1, len(found) + 1):
            if k == len(found) or marks[k] != marks[at]:
                yield marks[at], found[at:k]
                at = k


SCANNED = "path string, start long, size long, outside boolean, inside boolean, n_lines long, utf8 boolean, gb18030 boolean, nul boolean"


def scan(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One row for each range: where it leads from outside quotes and from inside, its number of
    lines, and whether it decodes."""
    ends = splitter(sep.encode())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = None, None
        for mark, found in _ranges(batches, KEY):
            if mark != key:
                if row:
                    yield pa.RecordBatch.from_pylist([row], SCHEMA)
                key, row = mark, dict(zip(KEY, mark, strict=True)) | {"outside": False, "inside": True, "n_lines": 0, "utf8": True, "gb18030": True, "nul": False}
            whole = b"\n".join(found)
            if b'"' in whole:
                for line in found:
                    for x, _ in pieces(line):
                        row["outside"], row["inside"] = ends(x, row["outside"]), ends(x, row["inside"])
            row["n_lines"] += len(found) + (sum(len(pieces(x)) - 1 for x in found) if b"\r" in whole else 0)
            if not whole.isascii():
                row["utf8"], row["gb18030"] = row["utf8"] and _decodes(whole, "utf-8"), row["gb18030"] and _decodes(whole, "gb18030")
            row["nul"] = row["nul"] or b"\0" in whole
        if row:
            yield pa.RecordBatch.from_pylist([row], SCHEMA)

    return lines(spark, path).mapInArrow(run, SCANNED)


SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), *[(c, pa.bool_()) for c in ("outside", "inside")], ("n_lines", pa.int64()), *[(c, pa.bool_()) for c in ("utf8", "gb18030", "nul")]])


def marked(scanned: DataFrame, encoding: str | None = None) -> DataFrame:
    """``path, start, size`` with ``opened`` (the range begins inside quotes), ``before`` (lines in
    front of it), ``encoding`` and ``nul`` of its file.

    UTF-8 if the whole file is valid, else GB18030 if it is, else UTF-8 with bad bytes replaced.
    Windows see ranges only, and those of a file are as many as its size has blocks.
    """
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("path")
    swap = F.col("outside") & ~F.col("inside")
    upto = F.sum(swap.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    fixed = F.last(F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("value"), "upto")), True).over(before)
    swaps = F.coalesce(F.sum(swap.cast("int")).over(before), F.lit(0))
    out = scanned.withColumn("upto", upto).withColumn("fixed", fixed).withColumn("swaps", swaps)
    odd = (F.col("swaps") - F.coalesce("fixed.upto", F.lit(0))) % 2 == 1
    found = F.when(F.min("utf8").over(file), "utf-8").when(F.min("gb18030").over(file), "gb18030").otherwise("utf-8")
    return out.select(
        *KEY,
        (F.coalesce("fixed.value", F.lit(False)) != odd).alias("opened"),
        F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("before"),
        (F.lit(encoding) if encoding else found).alias("encoding"),
        F.max("nul").over(file).alias("nul"),
    )


def with_marks(spark: SparkSession, path: str, marks: DataFrame) -> DataFrame:
    """Lines with the marks of their range, in file order."""
    rows = lines(spark, path)
    if marks.count() <= MOST_RANGES:
        out = rows.join(F.broadcast(marks), KEY, "left")
    else:
        out = rows.withColumn("at", F.monotonically_increasing_id()).join(marks, KEY, "left").repartition(*KEY).sortWithinPartitions(*KEY, "at")
    moved = F.raise_error(F.lit("the files or their ranges changed between two passes"))
    return out.withColumn("opened", F.when(F.col("opened").isNull(), moved.cast("boolean")).otherwise(F.col("opened")))


def numbered_lines(spark: SparkSession, path: str, marks: DataFrame) -> DataFrame:
    """``path, line_no, line``: decoded lines, numbered from 0 in each file."""
    columns = [*KEY, "before", "encoding"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, no = None, 0
        for mark, found in _ranges(batches, columns):
            file, start, _, before, encoding = mark
            if mark != key:
                key, no = mark, before
                if start == 0:
                    found[0] = found[0].removeprefix(BOM)
            out = [x.decode(encoding, "replace") for line in found for x, _ in pieces(line)]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(out)), pa.array(range(no, no + len(out)), pa.int32()), pa.array(out, pa.string())], names=["path", "line_no", "line"])
            no += len(out)

    return with_marks(spark, path, marks).select(*columns, "line").mapInArrow(run, "path string, line_no int, line string")


def records(spark: SparkSession, path: str, marks: DataFrame, sep: str = ",") -> DataFrame:
    """``path, start, no, kind, record``: the records of every range as text, and the parts of
    those that cross a border; the first record of a file is its header."""
    ends, columns = splitter(sep.encode()), [*KEY, "opened", "encoding"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, no, held, size, inside, first = None, [], 0, [], 0, False, False

        def emit(kind: int) -> None:
            nonlocal no, held, size
            text = b"".join(held)
            out.append((key[0], key[1], no, kind, text.decode(key[-1], "replace")))
            no, held, size = no + 1, [], 0

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=["path", "start", "no", "kind", "record"])
            out.clear()
            return batch

        def rest() -> None:
            if held:
                emit(MIDDLE if first else TAIL)

        for mark, found in _ranges(batches, columns):
            if mark != key:
                rest()
                if out:
                    yield sent()
                key, no = mark, 0
                inside = first = mark[3]
                head = mark[1] == 0
                if head:
                    found[0] = found[0].removeprefix(BOM)
            for line in found:
                for x, end in pieces(line):
                    held.append(x)
                    size += len(x)
                    inside = ends(x, inside)
                    if inside:
                        held.append(end)
                        if size > MOST_RECORD:
                            raise ValueError(f"a quote in {key[0]} is not closed within {MOST_RECORD} bytes")
                    elif first:
                        emit(HEAD)
                        first = False
                    elif head:
                        if x.strip() or len(held) > 1:
                            emit(HEADER)
                            head = False
                        else:
                            held, size = [], 0
                    elif x.strip() or len(held) > 1:
                        emit(WHOLE)
                    else:
                        held, size = [], 0
            if len(out) > 10_000:
                yield sent()
        rest()
        if out:
            yield sent()

    return with_marks(spark, path, marks).select(*columns, "line").mapInArrow(run, "path string, start long, no long, kind int, record string")


TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]


def joined(found: DataFrame) -> DataFrame:
    """``record`` of every record but headers; parts are joined where they cross borders.

    There are at most two parts a range, so the window of a file holds few rows.
    """
    parts = found.where(F.col("kind").isin(HEAD, TAIL, MIDDLE))
    order = Window.partitionBy("path").orderBy("start", "no")
    groups = parts.withColumn("group", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    crossing = groups.groupBy("path", "group").agg(F.array_sort(F.collect_list(F.struct("start", "no", "record"))).alias("parts"))
    return found.where(F.col("kind") == WHOLE).select("record").unionByName(crossing.select(F.array_join("parts.record", "").alias("record")))


def read_delimited(spark: SparkSession, path: str, sep: str, encoding: str | None = None) -> tuple[list[str], DataFrame]:
    """Names from the header, and one string column ``c0, c1 ...`` for each."""
    import csv

    marks = written(marked(scan(spark, path, sep), encoding))
    found = written(records(spark, path, marks, sep))
    header = found.where(F.col("kind") == HEADER).orderBy("path").select("record").first()
    if header is None:
        return [], spark.createDataFrame([], "c0 string").limit(0)
    names = [x.strip() for x in next(csv.reader([header[0]], delimiter=sep, skipinitialspace=True))]
    options = {"sep": sep, "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(names)))}
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    return names, joined(found).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
