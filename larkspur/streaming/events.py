"""Structured Streaming over event tables: the batch buckets, with late data bounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket(moment: Column, unit: str) -> Column:
    """GROUP BY DATE_FORMAT(ts, ...) as a truncation, which stays a timestamp."""
    return F.date_trunc(unit, moment)


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream of the Parquet files of a table's folder."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{table}.parquet")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of values per window and type; rows later than ``late`` are dropped
    and windows beyond it closed, so the state stays bounded."""
    timed = events.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", late)
    return (
        timed.groupBy(F.window("_t", width).alias("_w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("_w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further than ``gap`` apart."""
    timed = events.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", late)
    return (
        timed.groupBy("user_id", F.session_window("_t", gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("_w.start").cast("timestamp_ntz").alias("start"), "n")
    )


def _epochs(spark: SparkSession, state_path: str) -> list[int]:
    """Numbers of the states that are written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(state_path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(state_path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path(state_path))]
    return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(path(f"{state_path}/{n}/_SUCCESS")))


def state(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """The latest whole state, of those before an epoch if one is given."""
    known = [e for e in _epochs(spark, state_path) if before is None or e < before]
    return spark.read.parquet(f"{state_path}/epoch={known[-1]}") if known else None


def apply_changes(batches: DataFrame, state_path: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str):
    """Fold each micro-batch into the state: ``fold(state before, batch)`` gives the state
    after it (before the first there is none). A state is written under the number of its
    epoch from the one before, so a batch that is repeated after a failure overwrites its
    own result and nothing is applied twice or skipped."""

    def write(batch: DataFrame, epoch: int) -> None:
        before = state(batch.sparkSession, state_path, epoch)
        fold(before, batch).write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
