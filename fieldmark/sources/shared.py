"""Tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder where all executors can read and write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[")
        base = f"file://{tempfile.gettempdir()}/fieldmark-tables" if local else spark.conf.get("spark.sql.warehouse.dir") + "/_fieldmark"
    return f"{base}/fieldmark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame written in the shared folder and read again; cuts the lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
