"""Changes to tables as plans that give the changed table, and checks of constraints."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _last(rows: DataFrame, keys: Sequence[str], order: Column | None) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(order if order is not None else F.struct(*rows.columns).desc())
    return rows.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], mode: str = "replace", order: Column | None = None) -> DataFrame:
    """The table after INSERT of ``rows`` under unique ``keys``.

    mode: ``replace`` (REPLACE, ON DUPLICATE KEY UPDATE of all columns) or ``ignore``
    (INSERT IGNORE). Of several new rows under a key the first by ``order`` stands. Rows
    with a NULL key never collide. One anti join and a union; the table isn't shuffled
    if it's bucketed by the keys.
    """
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    loose = rows.where(~complete)
    fresh = _last(rows.where(complete), keys, order)
    if mode == "ignore":
        fresh = fresh.join(table.select(*keys), list(keys), "left_anti").select(*table.columns)
        return table.unionByName(fresh).unionByName(loose)
    if mode != "replace":
        raise ValueError(mode)
    kept = table.join(fresh.select(*keys), list(keys), "left_anti").select(*table.columns)
    return kept.unionByName(fresh).unionByName(loose)


def update(table: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """The table after UPDATE ... SET ... WHERE; where the condition is NULL nothing
    changes."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """The table after DELETE ... WHERE."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def delete_first(table: DataFrame, condition: Column, order: Sequence[Column], n: int, keys: Sequence[str]) -> DataFrame:
    """DELETE ... WHERE ... ORDER BY ... LIMIT n; ``order`` and then ``keys`` decide."""
    doomed = table.where(condition).orderBy(*order, *keys).limit(n).select(*keys)
    return table.join(doomed, list(keys), "left_anti")


def delete_joined(table: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DELETE of the rows that have a partner in ``other``."""
    return table.join(other.select(*keys), list(keys), "left_anti")


def duplicates(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once (UNIQUE); keys with a NULL don't count."""
    known = table.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key has no parent; NULL refers to nothing."""
    parents = parent.select(F.col(key).alias("_key")).distinct()
    return child.where(F.col(column).isNotNull()).join(parents, F.col(column) == F.col("_key"), "left_anti")


def violations(table: DataFrame, **checks: Column) -> DataFrame:
    """``check``, ``n``: rows for which each CHECK is false (NULL passes), in one scan."""
    sums = table.agg(*[F.count_if(~c).alias(n) for n, c in checks.items()])
    return sums.select(F.explode(F.create_map(*[x for n in checks for x in (F.lit(n), F.col(n))])).alias("check", "n"))


def column_statistics(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ANALYZE TABLE: ``name``, ``rows``, ``ndv``, ``nulls``, ``low``, ``high``, exact. Each
    column is scanned by itself and counted by value with map-side combine; no row is
    repeated for the number of columns."""
    parts = []
    for c in columns:
        values = table.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(
            values.agg(
                F.lit(c).alias("name"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                F.count("_v").alias("ndv"),
                F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("nulls"),
                F.min("_v").cast("string").alias("low"),
                F.max("_v").cast("string").alias("high"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def histogram(table: DataFrame, column: str, buckets: int) -> DataFrame:
    """Equi-height histogram: ``bucket``, ``low``, ``high``, ``n``. Bounds are percentiles,
    so no global sort of rows is needed to place them."""
    x = F.col(column)
    edges = table.agg(
        F.percentile(x.cast("double"), F.array(*[F.lit(i / buckets) for i in range(1, buckets)])).alias("_e")
    )
    placed = table.where(x.isNotNull()).join(F.broadcast(edges)).withColumn(
        "bucket", F.size(F.filter("_e", lambda e: e < x.cast("double")))
    )
    return placed.groupBy("bucket").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(F.lit(1)).alias("n"))


class MaterializedView:
    """A query kept as Parquet together with a fingerprint of its sources; read refreshes
    it first if a source has changed."""

    def __init__(self, spark: SparkSession, folder: str, sources: Mapping[str, str], sql: str):
        self.spark, self.folder, self.sources, self.sql = spark, folder, dict(sources), sql

    def fingerprint(self) -> str:
        """Hash of the text and of the names, sizes and times of the source files."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        seen = [self.sql]
        for name, place in sorted(self.sources.items()):
            path = fs_path(place)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files = fs.listFiles(path, True)
            while files.hasNext():
                f = files.next()
                seen.append(f"{name} {f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
        return hashlib.sha256("\n".join([seen[0], *sorted(seen[1:])]).encode()).hexdigest()[:16]

    def refresh(self) -> str:
        mark = self.fingerprint()
        tables = {n: self.spark.read.parquet(p) for n, p in self.sources.items()}
        self.spark.sql(self.sql, **tables).write.mode("overwrite").parquet(f"{self.folder}/{mark}")
        return mark

    def stale(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.fingerprint()}/_SUCCESS")
        return not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        mark = self.refresh() if self.stale() else self.fingerprint()
        return self.spark.read.parquet(f"{self.folder}/{mark}")
