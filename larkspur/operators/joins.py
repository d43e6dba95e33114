"""Joins beyond the built-in ones: NATURAL/USING shapes, bands, skewed keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, right: DataFrame, column: str, key: str) -> DataFrame:
    """``column NOT IN (SELECT key FROM right)``: nothing if ``right`` has a NULL, all rows if
    it is empty, else the rows with a known value that isn't there. NULLs are counted
    once, so that what is left is a plain anti join; Spark's own null-aware one always
    broadcasts ``right``."""
    there = right.select(F.col(key).alias("_key"))
    known = left.sparkSession.sql(
        "SELECT *, (SELECT count(*) FROM {r}) AS _n, (SELECT count(*) FROM {r} WHERE _key IS NULL) AS _nulls FROM {l}", l=left, r=there
    )
    kept = known.where((F.col("_n") == 0) | (F.col("_nulls") == 0) & F.col(column).isNotNull()).drop("_n", "_nulls")
    return kept.join(there, F.col(column) == F.col("_key"), "left_anti")


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """All shared columns, once and first, then the rest of either side; without a shared
    column a cross product of the two, as the standard has it."""
    shared = [c for c in left.columns if c.lower() in {r.lower() for r in right.columns}]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def using(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return left.join(right, keys, how)


#: Buckets that a range is cut into at most before wider ones are taken.
SPAN = 64


def band(
    left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner"
) -> DataFrame:
    """``left.point BETWEEN right.low AND right.high`` as an equi-join on buckets.

    Ranges are cut into buckets of ``width``; a point meets only the ranges of its own
    bucket, so there is no nested loop. Choose the width near the usual length of a
    range: ranges of more than SPAN buckets take buckets SPAN times as wide (and so on),
    each width in a join of its own, so that none becomes many rows. Which widths there
    are is asked first. NULL bounds match nothing. ``how``: inner, left_semi, left_anti.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(how)
    length = (F.col(high) - F.col(low)).cast("double") / width
    level = F.greatest(F.ceil(F.log(F.greatest(length, F.lit(1.0))) / F.log(F.lit(float(SPAN)))) - 1, F.lit(0)).cast("int")
    ranges = right.where(F.col(low) <= F.col(high)).withColumn("_l", level)
    levels = sorted(r[0] for r in ranges.select("_l").distinct().collect())

    def joined(rows: DataFrame, level: int, kind: str) -> DataFrame:
        wide = width * SPAN**level
        cut = F.explode(F.sequence(F.floor(F.col(low) / wide), F.floor(F.col(high) / wide)))
        r = ranges.where(F.col("_l") == level).withColumn("_rb", cut).drop("_l")
        on = (F.col("_b") == F.col("_rb")) & (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
        return rows.withColumn("_b", F.floor(F.col(point) / wide)).join(r, on, kind).drop("_b", "_rb")

    if how == "inner":
        parts = [joined(left, n, how) for n in levels] or [left.join(right, F.lit(False))]
        return reduce(DataFrame.unionAll, parts)
    rest, found = left, []
    for n in levels:
        found.append(joined(rest, n, "left_semi"))
        rest = joined(rest, n, "left_anti")
    return rest if how == "left_anti" else reduce(DataFrame.unionAll, found or [left.where(F.lit(False))])


def salted(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys of the left side spread over ``salts`` tasks; the right
    side is repeated that many times, so it should be the smaller one."""
    spread = F.pmod(F.xxhash64(*[c for c in left.columns if c != key] or [key]), F.lit(salts)).cast("int")
    l_side = left.withColumn("_salt", spread)
    r_side = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l_side.join(r_side, [key, "_salt"], how).drop("_salt")


def broadcast_if_small(df: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only if the optimiser's size bound is within the limit; else leave
    the choice to adaptive execution, which measures."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit_bytes else df


def null_safe(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
