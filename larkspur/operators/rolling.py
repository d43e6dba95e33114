"""Totals and averages over trailing periods, for every entity and calendar day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import shuffle_width

#: Moments that stand for "not known" in the source systems.
PLACEHOLDERS = ("1970-01-01 00:00:00",)


def known_moment(moment: Column, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """``moment`` as a zoneless timestamp, NULL where it is a placeholder."""
    moment = moment.cast("timestamp_ntz")
    for p in placeholders:
        moment = F.when(moment != F.lit(p).cast("timestamp_ntz"), moment)
    return moment


def once_per_key(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row for each ``key``: the values of the row with the smallest ``order``.
    Rows without a key are kept as they are, each on its own.

    ``min_by`` over fixed-width columns has a mutable buffer, so this is a hash
    aggregate with map-side combine, not a sort.
    """
    picked = [F.min_by(F.col(c), F.col(order)).alias(c) for c in columns]
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(*picked).select(*columns)
    return keyed.unionAll(df.where(F.col(key).isNull()).select(*columns))


def rolling_totals(
    df: DataFrame,
    entity: str = "user_id",
    moment: str = "placed_at",
    value: str = "amount",
    key: str | None = "id",
    arrival: str | None = "loaded_at",
    periods: Sequence[int] = (7, 30),
    placeholders: Sequence[str] = PLACEHOLDERS,
) -> DataFrame:
    """Trailing totals of ``value`` for each entity and each calendar day from the
    entity's first to its last day with a row.

    Columns: ``entity``, ``day`` and for each period p ``n_p`` (rows in the period),
    ``total_p`` (double; 0 where there is nothing to add), ``avg_p`` (mean of the
    values present, NULL if none) and ``day_avg_p`` (total by calendar days of the
    period that the entity has lived so far).

    Rows repeated under one ``key`` count once (the earliest by ``arrival``). Rows
    without entity or without a known moment have no place in the calendar and are
    left out; a NULL value counts as a row with nothing to add. Other columns of
    ``df`` are ignored, whatever their names. An empty table gives an empty result.
    Values are added as whole hundredths, so totals are exact.

    Plan: dedup by key (an even shuffle), daily sums with map-side combine (so a hot
    entity is at most one row a day and map task), then one partition per group of
    entities, where a calendar is filled between neighbouring days by ``sequence``
    and windows over a fixed number of preceding rows become differences of running
    sums: two additions a row however long the period.
    """
    moment_col = known_moment(F.col(moment), placeholders)
    narrow = df.select(
        F.col(entity).alias("_e"),
        F.to_date(moment_col).alias("_d"),
        F.round(F.col(value).cast("decimal(18,2)") * 100).cast("bigint").alias("_c"),
        (F.col(key) if key else F.lit(None).cast("bigint")).alias("_k"),
        (F.unix_micros(F.col(arrival).cast("timestamp")) if arrival else F.lit(0)).alias("_a"),
    )
    if key:
        narrow = once_per_key(narrow, "_k", "_a", ["_e", "_d", "_c"])
    daily = (
        narrow.where(F.col("_e").isNotNull() & F.col("_d").isNotNull())
        .groupBy("_e", "_d")
        .agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_c"), F.count("_c").alias("_v"), F.count(F.lit(1)).alias("_n"))
        .repartition(shuffle_width(df.sparkSession), "_e")
    )
    by_day = Window.partitionBy("_e").orderBy("_d")
    gaps = daily.withColumn("_next", F.date_sub(F.lead("_d").over(by_day), 1))
    dense = gaps.select(
        "_e", "_c", "_v", "_n", F.posexplode(F.sequence("_d", F.coalesce("_next", "_d"))).alias("_p", "_d")
    )
    real = F.col("_p") == 0
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    running = dense.select(
        "_e",
        "_d",
        *[F.sum(F.when(real, F.col(c)).otherwise(F.lit(0))).over(so_far).alias(c) for c in ("_c", "_v", "_n")],
        F.row_number().over(by_day).alias("_i"),
    )
    before = {
        (c, p): F.lag(c, p, 0).over(by_day).alias(f"{c}{p}") for p in periods for c in ("_c", "_v", "_n")
    }
    shifted = running.select("*", *before.values())
    out: list[Column] = [F.col("_e").alias(entity), F.col("_d").alias("day")]
    for p in periods:
        cents, present, rows = (F.col(c) - F.col(f"{c}{p}") for c in ("_c", "_v", "_n"))
        total = cents.cast("double")
        out += [
            rows.alias(f"n_{p}"),
            (total / 100).alias(f"total_{p}"),
            (F.when(present > 0, total / present) / 100).alias(f"avg_{p}"),
            (total / F.least(F.col("_i"), F.lit(p)) / 100).alias(f"day_avg_{p}"),
        ]
    return shifted.select(*out)
