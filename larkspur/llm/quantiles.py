"""Percentiles per group from compressed dyadic-tree counts (q-digest).

Values are quantised to an ordered universe of 2^17 codes; a digest counts codes and,
where counts are small, whole dyadic ranges of codes. Digests of any two sets of rows
are joined by adding the counts of equal nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.changes import group_starts
from larkspur.operators.rolling import known_moment, once_per_key
from larkspur.session import cut

LEVELS, MANTISSA = 17, 10
HALF = 1 << (LEVELS - 1)
SHIFT = LEVELS + 1
MASK = (1 << SHIFT) - 1
#: A code holds values that differ by at most this share of the value.
VALUE_ERROR = 2.0**-MANTISSA
SMALL = 1 << MANTISSA


def code_of(cents: Column) -> Column:
    """Ordered code of a bigint: exact below 2^10, then 2^10 steps in each power of two.
    All bigints but the smallest, which has no absolute value, have a code."""
    m = F.abs(F.greatest(cents, F.lit(1 - (1 << 63))))
    e = F.greatest(F.floor(F.log2(F.greatest(m, F.lit(1)).cast("double"))), F.lit(MANTISSA)) - MANTISSA
    code = (e * SMALL + F.call_function("shiftright", m, e.cast("int"))).cast("int")
    return F.when(cents < 0, HALF - code).otherwise(HALF + code)


def value_of(code: np.ndarray) -> np.ndarray:
    """Middle of a code's values, in hundredths."""
    m = np.abs(code.astype(np.int64) - HALF)
    e = np.maximum(m // SMALL - 1, 0)
    low = (m - e * SMALL) << e
    middle = low + ((np.int64(1) << e) - 1) / 2
    return np.where(code < HALF, -middle, middle)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Move children into their parent, from the leaves up, where the family counts at
    most n / k; n is the count of the group. Nodes are heap numbers: root 1, leaf
    2^17 + code. A node that isn't a leaf then counts at most n / k, so a rank is off
    by at most 17 n / k. ``group`` holds small integers; all groups go at once."""
    limit = np.bincount(group, count).astype(np.int64) // k
    fixed = limit[group] < 1
    done = [(group[fixed].astype(np.int64) << SHIFT | node[fixed], count[fixed])]
    key, count = group[~fixed].astype(np.int64) << SHIFT | node[~fixed], count[~fixed]
    for level in range(LEVELS, 0, -1):
        own = (key & MASK) >= (1 << level)
        rest, rest_c = key[~own], count[~own]
        order = np.argsort(rest)
        rest, rest_c = rest[order], rest_c[order]
        child, child_c = key[own], count[own]
        above = (child >> SHIFT) << SHIFT | ((child & MASK) >> 1)
        parent, back = np.unique(above, return_inverse=True)
        family = np.bincount(back, child_c, len(parent)).astype(np.int64)
        at = np.searchsorted(rest, parent)
        there = np.zeros(len(parent), bool)
        inside = at < len(rest)
        there[inside] = rest[at[inside]] == parent[inside]
        family[there] += rest_c[at[there]]
        up = family <= limit[parent >> SHIFT]
        stay = ~up[back]
        done.append((child[stay], child_c[stay]))
        rest_c[at[up & there]] = family[up & there]
        new = up & ~there
        key, count = np.concatenate([rest, parent[new]]), np.concatenate([rest_c, family[new]])
    done.append((key, count))
    key, count = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(key)
    return key[order] >> SHIFT, key[order] & MASK, count[order]


def quantile(group: np.ndarray, node: np.ndarray, count: np.ndarray, q: Sequence[float]) -> np.ndarray:
    """(groups, q) of values at rank ceil(q n) (at least 1), in hundredths; groups are
    numbered 0, 1, ... without gaps."""
    level = np.floor(np.log2(node)).astype(np.int64)
    last = ((node + 1) << (LEVELS - level)) - 1 - (1 << LEVELS)
    order = np.lexsort((-level, last, group))
    so_far, last = np.cumsum(count[order]), last[order]
    n = np.bincount(group, count).astype(np.int64)
    base = np.cumsum(n) - n
    rank = np.maximum(np.ceil(n[:, None] * np.asarray(q)[None, :] - 1e-9), 1).astype(np.int64)
    return value_of(last[np.searchsorted(so_far, base[:, None] + rank)])


def digests(df: DataFrame, groups: Sequence[str], cents: str, k: int) -> DataFrame:
    """Digests of the groups: ``groups``, ``node``, ``count``. Leaves are counted with
    map-side combine, so a group comes to its task as at most 2^17 rows however many
    it has. NULL values are not counted; a NULL group is a group."""
    leaves = (
        df.where(F.col(cents).isNotNull())
        .groupBy(*groups, (code_of(F.col(cents)) + (1 << LEVELS)).cast("long").alias("node"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _compressed(leaves, groups, k)


def merge(parts: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """Digests of coarser groups from digests: equal nodes are added, then compressed."""
    return _compressed(parts.groupBy(*groups, "node").agg(F.sum("count").alias("count")), groups, k)


def _by_group(nodes: DataFrame, groups: Sequence[str], act: Callable, schema: str | T.StructType) -> DataFrame:
    """Run ``act(group keys, group, node, count)`` over whole groups, many at a time. A
    group has at most 2^18 nodes; what is held is one Arrow batch and one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
            new = group_starts(t, groups)
            group = np.cumsum(new) - 1
            keys = t.select(list(groups)).take(pa.array(np.flatnonzero(new)))
            yield from act(keys, group, t["node"].to_numpy(), t["count"].to_numpy()).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            at = int(np.flatnonzero(group_starts(t, groups))[-1])
            if at:
                yield from settle(t.slice(0, at))
            carry = t.slice(at)
        if carry is not None:
            yield from settle(carry)

    placed = nodes.select(*groups, "node", "count")
    placed = placed.repartition(*groups) if groups else placed.repartition(1)
    return (placed.sortWithinPartitions(*groups) if groups else placed).mapInArrow(run, schema)


def _compressed(nodes: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    def squeeze(keys: pa.Table, group: np.ndarray, node: np.ndarray, count: np.ndarray) -> pa.Table:
        group, node, count = compress(group, node, count, k)
        out = keys.take(pa.array(group))
        return out.append_column("node", pa.array(node)).append_column("count", pa.array(count))

    return _by_group(nodes, groups, squeeze, nodes.select(*groups, "node", "count").schema)


def percentiles(parts: DataFrame, groups: Sequence[str], k: int, q: Sequence[float]) -> DataFrame:
    """One row a group: ``groups``, ``n``, a double ``pXX`` for each q, ``rank_error``
    (share of n by which a rank may be off at most) and ``value_error`` (share of the
    value)."""
    names = [f"p{round(x * 100, 4):g}".replace(".", "_") for x in q]
    added = [T.StructField(n, T.DoubleType()) for n in (*names, "rank_error", "value_error")]
    schema = T.StructType([*parts.select(*groups).schema.fields, T.StructField("n", T.LongType()), *added])

    def read(keys: pa.Table, group: np.ndarray, node: np.ndarray, count: np.ndarray) -> pa.Table:
        n = np.bincount(group, count).astype(np.int64)
        out = keys.append_column("n", pa.array(n))
        for name, values in zip(names, quantile(group, node, count, q).T):
            out = out.append_column(name, pa.array(values / 100))
        out = out.append_column("rank_error", pa.array(LEVELS * (n // k) / n))
        return out.append_column("value_error", pa.array(np.full(len(n), VALUE_ERROR)))

    return _by_group(parts, groups, read, schema)


def daily_amounts(orders: DataFrame) -> DataFrame:
    """``day``, ``status``, ``_c``: one row an order, amounts in hundredths. The day is NULL
    where the moment is unknown or a placeholder; status is compared without case and
    surrounding blanks; empty and NULL are one group, NULL."""
    status = F.lower(F.regexp_replace("status", r"^\s+|\s+$", ""))
    narrow = orders.select(
        "id",
        F.to_date(known_moment(F.col("placed_at"))).alias("day"),
        F.when(status != "", status).alias("status"),
        F.round(F.col("amount").cast("decimal(18,2)") * 100).cast("bigint").alias("_c"),
        F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("_a"),
    )
    return once_per_key(narrow, "id", "_a", ["day", "status", "_c"])


#: Percentiles that are given, and nodes that a digest keeps at least: 17 n / k is 0.5 %.
WANTED, KEPT = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99), 3400


def order_digests(orders: DataFrame, k: int = KEPT) -> DataFrame:
    """Digests of the amounts of each day and status: ``day``, ``status``, ``node``,
    ``count``. What a day's run stores; ``merge`` joins those of any days."""
    return digests(daily_amounts(orders), ["day", "status"], "_c", k)


def order_percentiles(orders: DataFrame, q: Sequence[float] = WANTED, k: int = KEPT) -> DataFrame:
    """Percentiles of ``amount`` by status for each day and for the whole.

    Columns: ``scope`` (day, all), ``day`` (NULL for the whole, and for the orders whose
    moment is unknown or a placeholder), ``status`` and those of ``percentiles``. Each
    order counts once. Orders without amount aren't counted; a group without any amount
    has no row. The whole is merged from the digests of the days, which are
    checkpointed, as both results read them.
    """
    days = cut(order_digests(orders, k))
    whole = merge(days, ["status"], k)
    by_day = percentiles(days, ["day", "status"], k, q).select(F.lit("day").alias("scope"), "*")
    overall = percentiles(whole, ["status"], k, q).select(
        F.lit("all").alias("scope"), F.lit(None).cast("date").alias("day"), "*"
    )
    return by_day.unionByName(overall)


def percentile_bounds(orders: DataFrame, q: Sequence[float] = WANTED, k: int = KEPT) -> DataFrame:
    """The stated error against exact ranks: ``scope``, ``day``, ``status``, ``n`` and
    ``within``, true if every percentile's value stands, within its value error, at a
    rank that is off by no more than the rank error (and a row)."""
    amounts = daily_amounts(orders).where("_c is not null")
    rows = amounts.select(F.lit("day").alias("scope"), "day", "status", "_c").unionAll(
        amounts.select(F.lit("all").alias("scope"), F.lit(None).cast("date").alias("day"), "status", "_c")
    )
    counts = rows.groupBy("scope", "day", "status", "_c").agg(F.count(F.lit(1)).alias("_n"))
    names = [f"p{round(x * 100, 4):g}".replace(".", "_") for x in q]
    found = order_percentiles(orders, q, k).select(
        F.col("scope").alias("s"), F.col("day").alias("d"), F.col("status").alias("t"), *names, "rank_error", "value_error"
    )
    both = counts.join(
        found, (F.col("scope") == F.col("s")) & F.col("day").eqNullSafe(F.col("d")) & F.col("status").eqNullSafe(F.col("t"))
    )
    ok = F.lit(True)
    sums = [F.sum("_n").alias("n"), F.first("rank_error").alias("_e")]
    for x, name in zip(q, names):
        room = F.abs(F.col(name) * 100) * F.col("value_error") + 1
        sums += [
            F.sum(F.when(F.col("_c") < F.col(name) * 100 - room, F.col("_n")).otherwise(0)).alias(f"{name}_lo"),
            F.sum(F.when(F.col("_c") <= F.col(name) * 100 + room, F.col("_n")).otherwise(0)).alias(f"{name}_hi"),
        ]
        slack = F.col("_e") * F.col("n") + 1
        ok = ok & (F.col(f"{name}_lo") - slack <= x * F.col("n")) & (F.col(f"{name}_hi") + slack >= x * F.col("n"))
    return both.groupBy("scope", "day", "status").agg(*sums).select("scope", "day", "status", "n", ok.alias("within"))
