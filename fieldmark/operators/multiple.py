"""A ledger of tests and control of multiple testing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.operators.ranks import running

LEDGER = "at timestamp, source string, label string, kind string, p double, n long, exploratory boolean"


def register(spark: SparkSession, path: str, entries: list[dict], source: str = "") -> int:
    """Append tests that have a p-value to the ledger's folder; returns how many."""
    rows = [(e["label"], e.get("kind", ""), float(e["p"]), e.get("n"), bool(e.get("exploratory", False))) for e in entries if e.get("p") is not None]
    if rows:
        df = spark.createDataFrame(rows, "label string, kind string, p double, n long, exploratory boolean")
        df.select(F.current_timestamp().alias("at"), F.lit(source).alias("source"), "label", "kind", "p", "n", "exploratory").write.mode("append").parquet(path)
    return len(rows)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The tests since the last reset."""
    try:
        resets = spark.read.schema("at timestamp").parquet(f"{path}_resets")
    except AnalysisException:  # the ledger was never reset
        return spark.read.schema(LEDGER).parquet(path)
    since = F.lit(resets.agg(F.max("at")).first()[0])
    return spark.read.schema(LEDGER).parquet(path).where(F.col("at") > since)


def reset(spark: SparkSession, path: str) -> str | None:
    """Begin the ledger anew and copy its tests so far to a history folder; None if there are none.

    Nothing is overwritten: a mark at the newest test's time is appended beside the ledger, and
    only later tests count. A test that is registered meanwhile stays, since its time is later.
    """
    tests = load(spark, path)
    newest, stamp = tests.agg(F.max("at"), F.date_format(F.max("at"), "yyyyMMddHHmmssSSSSSS")).first()
    if newest is None:
        return None
    kept = f"{path}_history/{stamp}"
    tests.where(F.col("at") <= F.lit(newest)).write.mode("overwrite").parquet(kept)
    spark.createDataFrame([(newest,)], "at timestamp").write.mode("append").parquet(f"{path}_resets")
    return kept


def adjust(tests: DataFrame, alpha: float = 0.05, family: list[str] | None = None, p: str = "p") -> DataFrame:
    """``tests`` plus ``m, bonferroni, bh_rank, bh_threshold, bh`` within each family.

    Bonferroni rejects p <= alpha / m; Benjamini-Hochberg all up to the largest p that is
    at most its place's share of alpha. Null p-values stand outside. Without ``family`` the places
    come from running counts over ranges, so any number of tests is ranked by many tasks;
    each named family is ranked in one.
    """
    some = F.col(p).isNotNull()
    if family:
        whole = Window.partitionBy(*family)
        out = tests.withColumn("m", F.count(p).over(whole))
        out = out.withColumn("bh_rank", F.when(some, F.row_number().over(whole.orderBy(F.col(p).asc_nulls_last()))))
        last = F.max(F.when(F.col(p) <= F.col("bh_rank") * F.lit(alpha) / F.col("m"), F.col("bh_rank"))).over(whole)
    else:
        ranked = running(tests.where(some).withColumn("_one", F.lit(1)), [p], {"bh_rank": "_one"}).drop("_one")
        ranked = ranked.withColumn("bh_rank", F.col("bh_rank").cast("int"))
        m = ranked.count()
        last = ranked.agg(F.max(F.when(F.col(p) <= F.col("bh_rank") * F.lit(alpha) / F.lit(m), F.col("bh_rank")))).first()[0]
        out = ranked.unionByName(tests.where(~some), allowMissingColumns=True).withColumn("m", F.lit(m).cast("long"))
        last = F.lit(last).cast("int")
    out = out.withColumn("bonferroni", F.when(some, F.col(p) <= F.lit(alpha) / F.col("m"))).withColumn("bh_threshold", F.col("bh_rank") * F.lit(alpha) / F.col("m"))
    out = out.withColumn("bh", F.when(some, F.coalesce(F.col("bh_rank") <= last, F.lit(False))))
    return out.select(*tests.columns, "m", "bonferroni", "bh_rank", "bh_threshold", "bh")


def summary(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Counts of tests and rejections, and the chance of any false one, in all and by
    whether tests were exploratory (null: all)."""
    done = adjust(tests, alpha)
    got = done.where("p is not null").cube("exploratory").agg(F.count("*").alias("n_tests"), F.count_if(F.col("p") < alpha).alias("n_raw"), F.count_if("bonferroni").alias("n_bonferroni"), F.count_if("bh").alias("n_bh"), F.count_if((F.col("p") < alpha) & ~F.col("bh")).alias("n_dropped"))
    return got.withColumn("familywise", 1 - F.pow(F.lit(1 - alpha), F.col("n_tests")))
