"""Distinct counts from log-log registers that merge by maximum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.rolling import known_moment

PRECISION = 12
REGISTERS = 1 << PRECISION
RANK_BITS = 40
#: Standard error of an estimate, as a share of it.
STANDARD_ERROR = 1.04 / REGISTERS**0.5


def register_of(identifier: Column) -> tuple[Column, Column]:
    """Register (the hash's first 12 bits) and rank (1 + zeros that lead the next 40)."""
    h = F.xxhash64(identifier)
    rest = F.shiftrightunsigned(h, 64 - PRECISION - RANK_BITS).bitwiseAND(F.lit((1 << RANK_BITS) - 1))
    rank = F.when(rest == 0, RANK_BITS + 1).otherwise(RANK_BITS - F.floor(F.log2(rest.cast("double"))))
    return F.shiftrightunsigned(h, 64 - PRECISION).cast("int"), rank.cast("int")


def registers(df: DataFrame, groups: Sequence[str], identifier: str) -> DataFrame:
    """Registers of each group: ``groups``, ``register``, ``rank``; at most 4096 rows a
    group after the map-side combine, whatever its size. NULL isn't counted."""
    register, rank = register_of(F.col(identifier))
    return (
        df.where(F.col(identifier).isNotNull())
        .groupBy(*groups, register.alias("register"))
        .agg(F.max(rank).alias("rank"))
    )


def merge(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Registers of coarser groups, or of the union of several sets of registers."""
    return parts.groupBy(*groups, "register").agg(F.max("rank").alias("rank"))


def estimates(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``groups``, ``estimate`` (bigint) and ``standard_error`` (absolute), by the
    harmonic mean of the registers with the empty ones counted by their expected share
    (Ertl's correction for small sets), which needs no table of biases."""
    m = float(REGISTERS)
    totals = parts.groupBy(*groups).agg(
        F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_sum"), (m - F.count(F.lit(1))).alias("_empty")
    )
    # sigma(x) = x + sum of x^(2^i) 2^(i-1); the terms vanish long before i = 30.
    x = F.col("_empty") / m
    sigma = F.aggregate(
        F.sequence(F.lit(1), F.lit(30)),
        F.struct(x.alias("s"), x.alias("p"), F.lit(0.5).alias("w")),
        lambda a, _: F.struct(
            (a["s"] + a["p"] * a["p"] * a["w"] * 2).alias("s"), (a["p"] * a["p"]).alias("p"), (a["w"] * 2).alias("w")
        ),
        lambda a: a["s"],
    )
    value = (m * m / (2 * F.log(F.lit(2.0)))) / (m * sigma + F.col("_sum"))
    return totals.select(
        *groups,
        F.round(value).cast("bigint").alias("estimate"),
        (value * STANDARD_ERROR).alias("standard_error"),
    )


def _narrow(orders: DataFrame) -> DataFrame:
    """``user_id``, ``day``, ``status``: status is compared without case and surrounding
    blanks; empty and NULL are one group, NULL, as are unknown and placeholder days."""
    status = F.lower(F.regexp_replace("status", r"^\s+|\s+$", ""))
    return orders.select(
        "user_id",
        F.to_date(known_moment(F.col("placed_at"))).alias("day"),
        F.when(status != "", status).alias("status"),
    )


def buyer_registers(orders: DataFrame) -> DataFrame:
    """Registers of the users of each day and status: ``day``, ``status``, ``register``,
    ``rank``. What a day's run stores; ``merge`` joins those of any days, statuses or
    runs by their maximum, and ``estimates`` reads them. Rows without a user have none."""
    return registers(_narrow(orders), ["day", "status"], "user_id")


def distinct_buyers(orders: DataFrame) -> DataFrame:
    """Distinct ``user_id`` by day, by status, by both and over all.

    Columns: ``scope`` (day_status, day, status, all), ``day``, ``status``,
    ``estimate``, ``standard_error``. Groups without any user have no row. Repeated
    orders change nothing. The coarser groups are merged from the registers of the
    finest.
    """
    finest = buyer_registers(orders)
    by_day = merge(finest, ["day"])
    by_status = merge(finest, ["status"])
    no_day, no_status = F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("status")
    parts = [
        ("day_status", estimates(finest, ["day", "status"]), ["day", "status"]),
        ("day", estimates(by_day, ["day"]), ["day", no_status]),
        ("status", estimates(by_status, ["status"]), [no_day, "status"]),
        ("all", estimates(merge(by_status, []), []), [no_day, no_status]),
    ]
    out = None
    for scope, df, keys in parts:
        df = df.select(F.lit(scope).alias("scope"), *keys, "estimate", "standard_error")
        out = df if out is None else out.unionByName(df)
    return out.where("estimate > 0")


def distinct_in_range(parts: DataFrame, first: str, last: str) -> DataFrame:
    """Distinct users by status from the stored registers of the days ``first`` to
    ``last``: ``status``, ``estimate``, ``standard_error``."""
    days = parts.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return estimates(merge(days, ["status"]), ["status"]).where("estimate > 0")


def distinct_bounds(orders: DataFrame) -> DataFrame:
    """The stated error against exact counts: ``scope``, ``day``, ``status``, ``exact`` and
    ``within``, true if the estimate is off by no more than five standard errors (and
    one). Exact counts take one row for each user, day and status."""
    pairs = _narrow(orders).where("user_id is not null").distinct()
    no_day, no_status = F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("status")
    exact = None
    for scope, keys in (("day_status", ["day", "status"]), ("day", ["day", no_status]), ("status", [no_day, "status"]), ("all", [no_day, no_status])):
        df = pairs.select(F.lit(scope).alias("scope"), *keys, "user_id").distinct()
        df = df.groupBy("scope", "day", "status").agg(F.count(F.lit(1)).alias("exact"))
        exact = df if exact is None else exact.unionByName(df)
    found = distinct_buyers(orders).select(
        F.col("scope").alias("s"), F.col("day").alias("d"), F.col("status").alias("t"), "estimate"
    )
    same = (F.col("scope") == F.col("s")) & F.col("day").eqNullSafe(F.col("d")) & F.col("status").eqNullSafe(F.col("t"))
    off = F.abs(F.col("estimate") - F.col("exact"))
    return exact.join(found, same, "left").select(
        "scope", "day", "status", "exact", F.coalesce(off <= 5 * STANDARD_ERROR * F.col("exact") + 1, F.lit(False)).alias("within")
    )
