"""Window frames that Spark's parser lacks, and named windows that build on others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larkspur.session import cut, shuffle_width

UNBOUNDED = None


@dataclass(frozen=True)
class Named:
    """A window clause: partition, order and frame, each of which may be inherited."""

    partition: tuple[str, ...] = ()
    order: tuple[Column, ...] = ()
    frame: tuple[str, int | None, int | None] | None = None

    def over(self, partition: Sequence[str] = (), order: Sequence[Column] = (), frame=None) -> Named:
        """``OVER (w ORDER BY ...)``: add what the named window hasn't; it may not be
        changed."""
        if partition and self.partition or order and self.order or frame and self.frame:
            raise ValueError("a window that builds on another may only add to it")
        return replace(
            self,
            partition=self.partition or tuple(partition),
            order=self.order or tuple(order),
            frame=self.frame or frame,
        )

    def spec(self) -> WindowSpec:
        w = Window.partitionBy(*self.partition)
        w = w.orderBy(*self.order) if self.order else w
        if self.frame is None:
            return w
        kind, lo, hi = self.frame
        low = Window.unboundedPreceding if lo is UNBOUNDED else lo
        high = Window.unboundedFollowing if hi is UNBOUNDED else hi
        return w.rowsBetween(low, high) if kind == "rows" else w.rangeBetween(low, high)


def check_bounds(lo: int | None, hi: int | None) -> None:
    for b in (lo, hi):
        if b is not None and (isinstance(b, bool) or not isinstance(b, int)):
            raise ValueError("frame bounds must be constant whole numbers")
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("the frame ends before it starts")


def groups_frame(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[Column],
    lo: int | None,
    hi: int | None,
    **aggs: Column,
) -> DataFrame:
    """``GROUPS BETWEEN lo AND hi``: frames of whole peer groups.

    A GROUPS frame is a RANGE frame over the dense rank of the order; both windows need
    the same partitioning, so there is one shuffle. None is unbounded, negative numbers
    precede. ``aggs`` are aggregate Columns without a window. NULL keys are peers.
    """
    check_bounds(lo, hi)
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("_g").rangeBetween(
        Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi
    )
    return ranked.select("*", *[a.over(frame).alias(n) for n, a in aggs.items()]).drop("_g")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY ...) over the whole table without one task for all: rows
    are placed by ranges of the order, numbered within each, and what the ranges before
    hold is added. The placed rows are checkpointed, as they are counted first. Only a
    count for each partition comes to the driver."""
    width = shuffle_width(df.sparkSession)
    placed = cut(df.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id()))
    counts = dict(placed.groupBy("_part").count().collect())
    if not counts:
        return placed.drop("_part").withColumn(name, F.lit(0).cast("long"))
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    offset = F.create_map(*[F.lit(x) for part, n in before.items() for x in (part, n)])[F.col("_part")]
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn(name, own + offset).drop("_part")


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each group; Spark keeps k rows a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= k)
