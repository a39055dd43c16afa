"""Versioned logs derived from the test tables, and runs cut from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import newest_wins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, runs: int = 10) -> DataFrame:
    """One record per event, keyed by user; errors are deletes.  ``run_id`` cuts the log into equal runs by sequence number."""
    events = table(spark, sf_dir, "events")
    n = max(1, events.count())  # from the footers
    gone = F.col("event_type") == "error"
    text = F.concat(F.col("event_type"), F.lit(":"), F.col("event_id").cast("string"))
    return events.select(
        (F.col("event_id") + 1).alias("seqno"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(gone, "").otherwise(text).alias("value"),
        gone.alias("tombstone"),
        (F.floor(F.col("event_id") * runs / n) + 1).cast("long").alias("run_id"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order: keys are unique, so sizes simply add up."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("seqno"),
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"),
        F.concat(F.col("o_orderstatus"), F.lit(":"), F.col("o_orderpriority")).alias("value"),
        (F.col("o_orderstatus") == "P").alias("tombstone"),
    )


def flushed(log: DataFrame) -> DataFrame:
    """Runs of a log with ``run_id``: the newest version of each key in each run, deletes included."""
    return newest_wins(log, ("run_id", "key"), unique=True)
