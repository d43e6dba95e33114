"""Reading and writing of files: delimited loads, tables from queries, catalogue views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    terminated: str = "\t",
    enclosed: str | None = None,
    escaped: str = "\\",
    lines: str | None = None,
    ignore_lines: int = 0,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    r"""LOAD DATA: fields and lines ended and enclosed as stated, ``\N`` is NULL, the first
    lines of each file left out. ``columns`` are the file's fields in order; columns of
    the schema that it doesn't name are NULL. What doesn't fit its type is NULL."""
    schema = spark.createDataFrame([], schema).schema
    order = list(columns) if columns else schema.names
    fields = T.StructType([T.StructField(c, T.StringType()) for c in order])
    reader = (
        spark.read.schema(fields).option("sep", terminated).option("nullValue", "\\N").option("escape", escaped)
        .option("quote", enclosed or "\0").option("multiLine", enclosed is not None and lines is None)
    )
    reader = reader.option("lineSep", lines) if lines else reader
    if ignore_lines == 1:
        raw = reader.option("header", True).option("enforceSchema", True).csv(path)
    elif ignore_lines:
        text = spark.read.option("lineSep", lines or "\n").text(path)
        # The line's place in its file: only the first block of a file holds its head, and
        # its lines are numbered one after the other, whatever files a task reads.
        text = text.select(
            "value", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")
        )
        first = text.where("_b = 0").groupBy("_p").agg(F.min("_i").alias("_f"))
        kept = text.join(first, "_p", "left").where((F.col("_b") > 0) | (F.col("_i") - F.col("_f") >= ignore_lines))
        options = {"sep": terminated, "nullValue": "\\N", "escape": escaped, "quote": enclosed or "\0"}
        raw = kept.select(F.from_csv("value", fields.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    else:
        raw = reader.csv(path)
    have = {c.lower(): c for c in order}
    return raw.select(
        *[
            (F.col(have[f.name.lower()]).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def create_table_as(df: DataFrame, path: str, partition: Sequence[str] = (), order: Sequence[str] = ()) -> str:
    """CTAS into Parquet. Sorting within files by the usual filter columns lets later
    scans skip row groups; partition columns let them skip folders."""
    out = df.repartition(*partition) if partition else df
    out = out.sortWithinPartitions(*partition, *order) if order else out
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return path


def insert_into(df: DataFrame, path: str) -> None:
    """INSERT ... SELECT: append by column name."""
    have = df.sparkSession.read.parquet(path)
    df.select(*[F.col(c).cast(have.schema[c].dataType) for c in have.columns]).write.mode("append").parquet(path)


def point_lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows by key; the equality reaches the Parquet scan as a pushed filter."""
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def columns_view(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """information_schema.columns of the named tables."""
    rows = [
        (t, i + 1, f.name, f.dataType.simpleString())
        for t, df in sorted(tables.items())
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, data_type string")
