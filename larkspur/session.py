"""Session settings, table access and lineage cutting."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("larkspur")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LARKSPUR_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder. Its schema is kept with the session, so only
    the first query of a table reads footers before it starts."""
    path = f"{folder}/{name}.parquet"
    known = spark.__dict__.setdefault("_larkspur_schemas", {})
    if path not in known:
        known[path] = spark.read.parquet(path).schema
    return spark.read.schema(known[path]).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for a stage whose rows multiply after the shuffle, so that its
    bytes before the shuffle say too little for AQE to pick the width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def cached(df: DataFrame) -> DataFrame:
    """The rows kept in columns in the executors' memory, or on their disks where that is
    full; a lost part is computed again. Free it with ``unpersist``."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def stream(df: DataFrame, batch: int = 1024) -> Iterator[list[Row]]:
    """Rows in batches, one partition at a time: a result of any size passes through the
    driver without being held there."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while some := list(islice(rows, batch)):
        yield some


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names in
    ``spark.checkpoint.dir``; a folder is only made up where that is unset."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, folder: str, name: str) -> str:
    """A place for a table we write ourselves, in the shared folder where one is named."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file:///tmp/larkspur-{os.getpid()}"
    mark = hashlib.sha256(f"{folder} {name}".encode()).hexdigest()[:12]
    return f"{base}/{name}-{mark}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per context, so that they need no
    installation and no common working directory."""
    context = spark.sparkContext
    if getattr(context, "_larkspur_sent", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="larkspur-")) / "larkspur.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._larkspur_sent = True


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least one partition a core, for scans that feed heavy Arrow stages. A
    table of many files or blocks is left as it is read; only one that is read in fewer
    pieces than there are cores is shuffled first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
