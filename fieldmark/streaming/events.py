"""Windowed statistics over an event stream: beyond the reference, which has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """``start, <by>, n, n_users, mean, sd`` of tumbling windows; late rows within the watermark count.

    The same frame works on a table and on a stream; users are counted approximately on both.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    got = rows.groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("n_users"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return got.select(F.col("window.start").alias("start"), by, "n", "n_users", "mean", "sd")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """``<user>, start, stop, n``: each user's sessions, parted by gaps."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    got = rows.groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))
    return got.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
