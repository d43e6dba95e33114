"""Aggregates of the dialect: exact averages, unsigned bits, lists, facets, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.semantics import unsigned


def sum_exact(x: Column, scale: int = 0) -> Column:
    """SUM of integers or decimals as a decimal; NULL if there is nothing to add."""
    return F.sum(x.cast(f"decimal(28,{scale})"))


def avg_exact(x: Column, scale: int = 0) -> Column:
    """AVG with 4 digits more than the input, rounded half away from zero."""
    return F.round(F.sum(x.cast(f"decimal(24,{scale + 4})")) / F.count(x), scale + 4)


def bit_or(x: Column) -> Column:
    return unsigned(F.coalesce(F.bit_or(x.cast("bigint")), F.lit(0).cast("bigint")))


def bit_and(x: Column) -> Column:
    """All ones for an empty group."""
    return unsigned(F.coalesce(F.bit_and(x.cast("bigint")), F.lit(-1).cast("bigint")))


def bit_xor(x: Column) -> Column:
    return unsigned(F.coalesce(F.bit_xor(x.cast("bigint")), F.lit(0).cast("bigint")))


def cut_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, cut between characters."""
    data = F.substring(F.encode(text, "utf-8"), 1, limit)
    # A byte that continues a character right after the cut means the last one is torn.
    torn = F.substring(F.encode(text, "utf-8"), limit + 1, 1).between(F.unhex(F.lit("80")), F.unhex(F.lit("BF")))
    hexed = F.hex(data)
    whole = F.regexp_replace(hexed, "(?:[CDEF][0-9A-F])(?:[89AB][0-9A-F])*$", "")
    kept = F.when(torn, F.decode(F.unhex(whole), "utf-8")).otherwise(F.decode(data, "utf-8"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(kept)


def group_concat(
    x: Column, separator: str = ",", order: Column | None = None, descending: bool = False, distinct: bool = False,
    limit: int | None = None,
) -> Column:
    """GROUP_CONCAT: NULLs skipped, NULL for no value, in the given order (else of the
    values), cut to ``limit`` bytes. A list is one cell and so bounded by its group."""
    key = x if order is None else order
    pair = F.when(x.isNotNull(), F.struct(key.alias("k"), x.cast("string").alias("x")))
    listed = F.collect_set(pair) if distinct else F.collect_list(pair)
    ordered = F.sort_array(listed, asc=not descending)
    texts = F.transform(ordered, lambda p: p["x"])
    joined = F.array_join(F.array_distinct(texts) if distinct else texts, separator)
    out = F.when(F.size(listed) > 0, joined)
    return out if limit is None else cut_bytes(out, limit)


def percentile(x: Column, p: float) -> Column:
    """Exact percentile, linear between neighbours at p (n - 1); p is clamped."""
    return F.percentile(x, min(max(p, 0.0), 1.0))


def facet(df: DataFrame, groups: Sequence[str], value: str, top: int | None = None) -> DataFrame:
    """``{"value": count, ...}`` for each group, most frequent first, then by value.

    Two-step: counts first (map-side combine), so only the different values of a group
    meet in one place. NULL values aren't counted; a group of NULLs only has ``{}``.
    """
    counts = df.groupBy(*groups, F.col(value).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if top is not None:
        # The first n of each group are picked where the counts lie, before any list.
        best = Window.partitionBy(*groups).orderBy(F.col("_v").isNull(), F.desc("_n"), "_v")
        counts = counts.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max(top, 1))
    pairs = F.sort_array(
        F.collect_list(F.when(F.col("_v").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))))
    )
    if top is not None:
        pairs = F.slice(pairs, 1, top)
    key = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"^\[(.*)\]$", 1)
    items = F.transform(pairs, lambda p: F.concat(key(p["v"]), F.lit(": "), (-p["n"]).cast("string")))
    text = F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}")).alias("facet")
    return counts.groupBy(*groups).agg(text)


def rollup(df: DataFrame, groups: Sequence[str], *aggs: Column) -> DataFrame:
    """GROUP BY ... WITH ROLLUP: every prefix of the groups and the grand total."""
    return df.rollup(*groups).agg(*aggs)


def having(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def skewed_sum(df: DataFrame, groups: Sequence[str], value: Column, salts: int = 32) -> DataFrame:
    """DISTINCT sum of a skewed group in two steps: the different values of a group are
    spread over salts before they are added."""
    salted = df.select(*groups, value.alias("_x")).withColumn("_s", F.pmod(F.xxhash64("_x"), F.lit(salts)))
    parts = salted.groupBy(*groups, "_s", "_x").agg(F.lit(1)).groupBy(*groups, "_s").agg(F.sum("_x").alias("_x"))
    return parts.groupBy(*groups).agg(F.sum("_x").alias("sum_distinct"))
