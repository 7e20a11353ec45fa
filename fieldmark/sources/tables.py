"""Tables and transcripts in, tables out."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import clean_columns, col
from fieldmark.operators.prep_columns import drop_all_null
from fieldmark.sources.ranges import marked, numbered_lines, read_delimited, scan
from fieldmark.sources.shared import shared_dir, written
from fieldmark.sources.workbooks import read_sav, read_workbooks

__all__ = ["shared_dir", "written"]

# Cells that count as missing, as pandas documents its readers' defaults.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Endings of files that are no text.
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".xlsx", ".xls", ".docx", ".pptx", ".pdf", ".sav", ".zip")


def allow_charsets(spark: SparkSession) -> None:
    """Let the session read charsets beyond Spark's default list, bad bytes replaced."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def sniff(spark: SparkSession, path: str) -> str:
    """UTF-8 if every file is valid UTF-8 from end to end, else GB18030 (or UTF-8, where no file is)."""
    found = {r["encoding"] for r in marked(scan(spark, path)).select("encoding").distinct().collect()}
    return "gb18030" if "gb18030" in found else "utf-8"


def separator(spark: SparkSession, path: str) -> str:
    """The one of comma, semicolon and tab that the first line has most of; of equals, the first."""
    line = spark.read.text(path).select(F.regexp_replace("value", '"[^"]*"', "").alias("line")).first()
    return max(",;\t", key=lambda x: line[0].count(x)) if line else ","


def typed(df: DataFrame) -> DataFrame:
    """String columns as long, double or boolean where every value that is there can be one; one scan."""
    is_long, is_double = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    tests = {"long": lambda c: c.rlike(is_long), "double": lambda c: c.rlike(is_double), "boolean": lambda c: F.lower(c).isin("true", "false")}
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df
    counts = df.agg(*[F.count(col(c)).alias(f"n{k}") for k, c in enumerate(names)], *[F.count_if(f(col(c))).alias(f"{t}{k}") for k, c in enumerate(names) for t, f in tests.items()]).first()
    kinds = {c: next((t for t in tests if counts[f"n{k}"] and counts[f"n{k}"] == counts[f"{t}{k}"]), "string") for k, c in enumerate(names)}
    return df.select(*[col(c).cast(kinds.get(c, t)).alias(c) for c, t in df.dtypes])


def read_table(spark: SparkSession, path: str, encoding: str | None = None, clean: bool = True, sep: str | None = None, sheet: int | str = 0, labels: bool = False) -> DataFrame:
    """A table by its ending: csv, tsv, txt (tabs), xlsx, sav, json, orc, parquet. Old workbooks (xls) raise.

    Columns keep their order; headers are cleaned and all-null columns dropped. Text files
    are read in parallel whatever their quotes and sizes (``sources.ranges``): each file is UTF-8 if it is
    valid throughout, else GB18030. Blank lines and cells that mean missing go; short
    records get nulls, cells beyond the header are dropped. Of several files the header is that of
    the first by path, and each has one. Of workbooks one ``sheet`` is read, by place or name; of SAV
    files values, or with ``labels`` their labels; both match columns of several files by name.
    """
    end = os.path.splitext(path.rstrip("/"))[1].lower()
    if end in (".csv", ".tsv", ".txt"):
        names, rows = read_delimited(spark, path, sep or (separator(spark, path) if end == ".csv" else "\t"), encoding)
        df = typed(rows.select(*[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in rows.columns])).toDF(*(names or rows.columns))
    elif end in (".json", ".jsonl"):
        df = spark.read.json(path)
    elif end == ".orc":
        df = spark.read.orc(path)
    elif end in (".xlsx", ".xlsm", ".sav"):
        names, rows = read_sav(spark, path, labels) if end == ".sav" else read_workbooks(spark, path, sheet)
        df = typed(rows.select(*[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in rows.columns])).toDF(*(names or rows.columns))
    elif end == ".xls":
        raise ValueError("old workbooks (xls) aren't read: save them as xlsx")
    else:
        df = spark.read.parquet(path)
    return drop_all_null(clean_columns(df)) if clean else df


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of text files, numbered from 0; binary ones raise.

    Files are read by ranges, each decoded as UTF-8 if the whole file is valid, else GB18030.
    """
    marks = written(marked(scan(spark, path)))
    named = F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in BINARY) + ")$")
    bad = marks.where(named | F.col("nul")).select("path").limit(1).collect()
    if bad:
        raise ValueError(f"not a text file: {bad[0]['path']}")
    return numbered_lines(spark, path, marks)


def looks_like_transcript(lines: DataFrame, head: int = 4000) -> DataFrame:
    """Paths whose first ``head`` characters have a metadata label in the first twenty lines or
    at least five ``speaker: text`` lines."""
    from fieldmark.operators.coding import METADATA, SPEAKER

    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    near = lines.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < head)
    meta = (F.col("line_no") < 20) & F.regexp_extract("line", SPEAKER, 1).isin(*METADATA)
    got = near.groupBy("path").agg(F.count_if(meta).alias("n_meta"), F.count_if(F.col("line").rlike(SPEAKER)).alias("n_spoken"), F.sum(F.length("line")).alias("n_chars"))
    return got.where((F.col("n_chars") >= 60) & ((F.col("n_meta") >= 1) | (F.col("n_spoken") >= 5)))


def only_transcript(lines: DataFrame) -> str | None:
    """The one path that looks like a transcript; None where none or several do."""
    found = [r["path"] for r in looks_like_transcript(lines).select("path").limit(2).collect()]
    return found[0] if len(found) == 1 else None


def write_text(spark: SparkSession, text: str, path: str, encoding: str = "UTF-8") -> None:
    """A report as a text file below ``path``, in UTF-8 or another encoding such as GBK."""
    if encoding.upper() != "UTF-8":
        allow_charsets(spark)
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1)
    # the text writer knows no encodings; separator and quote are characters that no report holds
    lines.write.options(encoding=encoding, sep="\u0001", quote="\u0002", emptyValue="", header=False).mode("overwrite").csv(path)


def read_lexicon(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``word``: words of two characters or more between white space; ``#`` begins a comment."""
    words = spark.read.text(path).select(F.explode(F.split(F.regexp_replace("value", "#.*$", ""), r"\s+")).alias("word"))
    if extra:
        words = words.unionByName(spark.createDataFrame([(w,) for w in extra], "word string"))
    return words.where(F.length("word") >= 2).distinct()


def write_table(df: DataFrame, folder: str, name: str, form: str = "csv") -> str:
    """Write a result under ``folder/name``; an earlier version stays in ``folder/_history``.

    The earlier version is kept by writing to a fresh folder and never over an old one:
    returns the path written. The newest is the largest name.
    """
    spark = df.sparkSession
    stamp = spark.sql("select date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]
    path = f"{folder}/{name}/v{stamp}-{uuid.uuid4().hex[:6]}"
    writer = df.write.option("header", True) if form == "csv" else df.write
    writer.format(form).save(path)
    return path
