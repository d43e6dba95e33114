"""Work-item ledger: which items each consumer has still to process.

A log of runs is folded into leases: a run leases a range of items at the moment it
reads, and its last log row settles the lease. Rows logged earlier by the same run
are stale writers and lose against the higher fence (the log time).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PENDING, LEASED, DONE = "pending", "leased", "done"


def settled_runs(runs: DataFrame, fence: str = "logged_at") -> DataFrame:
    """One row a run: the row with the highest fence; of rows with the same fence one
    that isn't ``ok`` wins, so that a doubtful run is repeated rather than skipped.
    Rows without ``run_id`` or fence settle nothing. ``max_by`` on a few rows a run."""
    fields = ["replica_id", "origin", "started_at", "from_lsn", "lsn", "state"]
    order = F.struct(F.col(fence), F.when(F.col("state") == "ok", 0).otherwise(1), F.struct(*fields))
    return (
        runs.where(F.col("run_id").isNotNull() & F.col(fence).isNotNull())
        .select("run_id", F.struct(*fields).alias("_r"), order.alias("_o"))
        .groupBy("run_id")
        .agg(F.max_by("_r", "_o").alias("_r"))
        .select("run_id", "_r.*")
    )


#: Items of the narrowest bucket of ranges, and how many buckets a range is cut into at
#: most before wider ones are taken (each level's are SPAN times as wide).
BUCKET, SPAN = 256, 64


def _cut_ranges(done: DataFrame) -> DataFrame:
    """Ranges of done items cut into buckets: ``origin``, ``replica_id``, ``_level``, ``_b``,
    ``_lo`` (exclusive), ``_hi``, ``_at``. A range of any length gives at most SPAN + 2
    rows, as long ones are cut into wider buckets."""
    length = (F.col("_hi") - F.col("_lo")).cast("double")
    level = F.greatest(F.ceil(F.log(length / BUCKET) / F.log(F.lit(float(SPAN)))) - 1, F.lit(0)).cast("int")
    width = F.col("_w")
    cut = done.withColumn("_level", level).withColumn("_w", (BUCKET * F.pow(F.lit(SPAN), F.col("_level"))).cast("long"))
    cut = cut.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_lo") + 1) / width), F.floor(F.col("_hi") / width))))
    # Runs that span a bucket alike differ only in their start; the latest covers all.
    return (
        cut.select(
            "origin", "replica_id", "_level", "_b", F.greatest("_lo", F.col("_b") * width - 1).alias("_lo"),
            F.least("_hi", (F.col("_b") + 1) * width - 1).alias("_hi"), "_at",
        )
        .groupBy("origin", "replica_id", "_level", "_b", "_lo", "_hi")
        .agg(F.max("_at").alias("_at"))
    )


def unfinished(items: DataFrame, runs: DataFrame, now: str | None = None, lease_seconds: int = 3600, salts: int = 64) -> DataFrame:
    """The ledger's items that aren't done: ``origin``, ``replica_id``, ``lsn``, ``state``.

    ``items``: ``origin``, ``lsn``, ``arrived_at``; repeats count from their first
    arrival. ``runs``: log rows ``run_id``, ``replica_id``, ``origin``, ``started_at``,
    ``from_lsn`` (exclusive), ``lsn`` (inclusive), ``state``, ``logged_at``. A consumer
    follows an origin if the log has a row for both; its ledger has every item of it.

    The log is folded into leases: the row of a run with the highest fence settles it,
    and rows of the run that come in with a lower one are stale writers. A run settled
    as ``ok`` makes the items of its range done that had arrived when it began; failed
    and undone runs give theirs back. A run last heard of as ``running`` holds a lease on
    what follows its ``from_lsn`` for ``lease_seconds`` from its start, as of ``now``;
    such items are leased, the others pending. Without ``now`` all leases have ended.

    Items without an LSN are no items; an item without a known arrival, and a run without
    a known start or range, are never done. Other columns are ignored. Empty tables give
    no rows.

    Plan: first arrivals by (origin, LSN) with map-side combine. The followers of an
    origin are joined on (origin, salt), so a hot origin spreads over ``salts`` groups.
    Ranges are cut into buckets of LSNs, which makes the range test an anti join on
    (origin, replica, bucket): even groups of few items. There is one for each width of
    buckets that ranges have, which is one unless they differ greatly in length.
    """
    arrived = (
        items.where("lsn is not null and origin is not null")
        .select("origin", "lsn", "arrived_at")
        .groupBy("origin", "lsn")
        .agg(F.min("arrived_at").alias("first_at"))
    )
    followers = (
        runs.where("origin is not null and replica_id is not null")
        .select("origin", "replica_id")
        .distinct()
        .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    left = arrived.withColumn("_s", F.pmod(F.xxhash64("lsn"), F.lit(salts)).cast("int")).join(followers, ["origin", "_s"])
    settled = settled_runs(runs)
    ranges = _cut_ranges(
        settled.where("state = 'ok' and from_lsn < lsn and started_at is not null").select(
            "origin", "replica_id", F.col("from_lsn").alias("_lo"), F.col("lsn").alias("_hi"), F.col("started_at").alias("_at")
        )
    )
    for level in sorted(r[0] for r in ranges.select("_level").distinct().collect()):
        d = left.withColumn("_b", F.floor(F.col("lsn") / (BUCKET * SPAN**level))).alias("d")
        r = ranges.where(F.col("_level") == level).alias("r")
        same = [F.col(f"d.{c}") == F.col(f"r.{c}") for c in ("origin", "replica_id", "_b")]
        covered = (
            (F.col("d.lsn") > F.col("r._lo")) & (F.col("d.lsn") <= F.col("r._hi")) & (F.col("d.first_at") <= F.col("r._at"))
        )
        left = d.join(r, [*same, covered], "left_anti").drop("_b")
    left = left.select("origin", "replica_id", "lsn")
    if now is None:
        return left.withColumn("state", F.lit(PENDING))
    at = F.lit(now).cast("timestamp_ntz")
    alive = (F.col("started_at") <= at) & (F.col("started_at") > at - F.make_dt_interval(secs=F.lit(lease_seconds)))
    held = settled.where("state = 'running'").where(alive).groupBy("origin", "replica_id").agg(F.min("from_lsn").alias("_held"))
    leased = F.coalesce(F.col("lsn") > F.col("_held"), F.lit(False))
    return left.join(held, ["origin", "replica_id"], "left").select(
        "origin", "replica_id", "lsn", F.when(leased, LEASED).otherwise(PENDING).alias("state")
    )


def open_items(items: DataFrame, runs: DataFrame) -> DataFrame:
    """``origin``, ``replica_id``, ``lsn``: what each consumer's next run has to process."""
    return unfinished(items, runs).select("origin", "replica_id", "lsn")


def item_states(items: DataFrame, runs: DataFrame, now: str, lease_seconds: int = 3600) -> DataFrame:
    """Counts of pending, leased and done items for each consumer and origin at ``now``."""
    follow = runs.where("origin is not null and replica_id is not null").select("origin", "replica_id").distinct()
    total = items.where("lsn is not null").groupBy("origin").agg(F.count_distinct("lsn").alias("_all"))
    waiting = (
        unfinished(items, runs, now, lease_seconds)
        .groupBy("origin", "replica_id")
        .agg(F.count_if(F.col("state") == PENDING).alias(PENDING), F.count_if(F.col("state") == LEASED).alias(LEASED))
    )
    return follow.join(total, "origin").join(waiting, ["origin", "replica_id"], "left").select(
        "origin",
        "replica_id",
        F.coalesce(PENDING, F.lit(0)).alias(PENDING),
        F.coalesce(LEASED, F.lit(0)).alias(LEASED),
        (F.col("_all") - F.coalesce(PENDING, F.lit(0)) - F.coalesce(LEASED, F.lit(0))).alias(DONE),
    )


class StaleLease(RuntimeError):
    """A writer came back after its lease was given to another."""


@dataclass(frozen=True)
class Lease:
    item: str
    token: int
    expires: float


class WorkLedger:
    """Ledger of work items (batches, files, ranges) in a shared folder of any Hadoop file
    system that creates a file only if it isn't there (HDFS, a local disk in tests).

    Each item is a folder of numbered records ``000001.json``: of two writers of a number
    one wins. The number is the fencing token. The state is that of the highest record;
    a lease past its end counts as pending. Every attempt writes to a path with its
    own token; ``path(item)`` is that of the attempt recorded as done, so that a holder
    whose lease has ended can't touch it. What other attempts wrote is left beside it.
    """

    def __init__(self, spark: SparkSession, folder: str, lease_seconds: float = 3600):
        self.spark, self.folder, self.lease_seconds = spark, folder.rstrip("/"), lease_seconds
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _records(self, item: str) -> list[int]:
        place = self._path(f"{self.folder}/items/{item}")
        if not self._fs.exists(place):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(place))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, item: str, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/items/{item}/{number:06d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        # A record that is being written, or whose writer died, holds nothing yet.
        return json.loads(text) if text else {"state": PENDING}

    def _append(self, item: str, number: int, record: dict) -> bool:
        place = self._path(f"{self.folder}/items/{item}/{number:06d}.json")
        try:
            stream = self._fs.create(place, False)
        except Py4JJavaError as e:
            if "exist" in str(e.java_exception).lower():
                return False
            raise
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        return True

    def state(self, item: str, now: float) -> tuple[str, int]:
        records = self._records(item)
        if not records:
            return PENDING, 0
        last = self._read(item, records[-1])
        if last["state"] == LEASED and last["expires"] <= now:
            return PENDING, records[-1]
        return last["state"], records[-1]

    def lease(self, item: str, now: float) -> Lease | None:
        """Lease a pending item, or None if it's held, done or another was faster."""
        state, token = self.state(item, now)
        if state != PENDING:
            return None
        expires = now + self.lease_seconds
        if not self._append(item, token + 1, {"state": LEASED, "expires": expires}):
            return None
        return Lease(item, token + 1, expires)

    def finish(self, lease: Lease, done: bool = True) -> None:
        """Settle a lease; StaleLease if anything was recorded since it was given."""
        newest = (self._records(lease.item) or [0])[-1]
        state = DONE if done else PENDING
        if newest != lease.token or not self._append(lease.item, lease.token + 1, {"state": state}):
            raise StaleLease(lease.item)

    def _output(self, item: str, token: int) -> str:
        return f"{self.folder}/output/{item}/{token:06d}"

    def path(self, item: str) -> str:
        """Output of a done item; LookupError if it isn't done."""
        records = self._records(item)
        if not records or self._read(item, records[-1])["state"] != DONE:
            raise LookupError(item)
        return self._output(item, records[-1] - 1)

    def process(self, item: str, df: DataFrame, now: float) -> bool:
        """Write ``df`` as the output of ``item`` under a lease; False if not ours to do."""
        lease = self.lease(item, now)
        if lease is None:
            return False
        try:
            df.write.mode("overwrite").parquet(self._output(item, lease.token))
        except Exception:
            self.finish(lease, done=False)
            raise
        self.finish(lease)
        return True
