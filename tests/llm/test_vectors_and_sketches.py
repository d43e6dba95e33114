"""Neighbours, percentiles and distinct counts against brute force and odd input."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest

from larkspur.llm import distinct, neighbours, quantiles
from larkspur.llm.neighbours import forest_neighbours, neighbour_pairs

VECTORS = "vec_id long, index_id int, metric int, dim int, vectors array<float>, node_key string"
ORDERS = "id long, user_id long, amount decimal(12,2), status string, placed_at timestamp_ntz, loaded_at timestamp_ntz"
T0 = datetime(2030, 1, 1)


def clustered(rng, n, dim):
    centres = rng.standard_normal((max(1, n // 25), dim)) * 3
    return (centres[rng.integers(len(centres), size=n)] + rng.standard_normal((n, dim)) * 0.4).astype(np.float32)


def brute(rows, k):
    out = {}
    usable = [
        (i, ix, m, np.array(v, np.float64))
        for i, ix, m, d, v, key in rows
        if key is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    for i, ix, m, v in usable:
        near = []
        for j, jx, _, w in usable:
            if jx != ix or i == j:
                continue
            if m == 0:
                dist = ((v - w) ** 2).sum()
            elif m == 1:
                dist = 1 - (v * w).sum() / np.sqrt((v * v).sum()) / np.sqrt((w * w).sum())
            else:
                dist = -(v * w).sum()
            near.append((round(float(dist), 9), j))
        out[i] = [j for _, j in sorted(near)[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for index, metric, dim in ((1, 0, 12), (2, 1, 16), (3, 2, 20)):
        data = clustered(rng, 300, dim)
        data[:40] = data[0]  # more copies than a list holds
        data[40:43] = data[40]
        for v in data:
            i += 1
            rows.append((i, index, metric, dim, [float(x) for x in v], "n"))
        rows += [
            (i + 1, index, metric, dim, None, "n"),
            (i + 2, index, metric, dim, [1.0], "n"),
            (i + 3, index, metric, dim, [0.0] * dim, "n"),
            (i + 4, index, metric, dim, [float("nan")] * dim, "n"),
            (i + 5, index, metric, dim, [1.0] * dim, None),
            (i + 6, index, metric, dim, [None] * dim, "n"),
        ]
        i += 6
    rows.append((5000, 9, 0, 2, [1.0, 2.0], "n"))
    return rows


@pytest.mark.parametrize("unit", [64, neighbours.UNIT])
def test_neighbours_recall(spark, vectors, unit, monkeypatch):
    monkeypatch.setattr(neighbours, "UNIT", unit)
    near = forest_neighbours(spark.createDataFrame(vectors, VECTORS).repartition(5))
    got = {r.vec_id: [x.id for x in r.near] for r in near.collect()}
    want = brute(vectors, 5)
    assert set(got) == set(want) and got[5000] == []
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    if unit == neighbours.UNIT and unit > 64:
        assert hits >= 0.999 * sum(map(len, want.values()))


def test_pairs_once(spark, vectors):
    near = forest_neighbours(spark.createDataFrame(vectors, VECTORS).selectExpr("*", "1 as near", "2 as _tree"))
    pairs = [tuple(r) for r in neighbour_pairs(near).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    want = {(min(i, j), max(i, j)) for i, js in brute(vectors, 5).items() for j in js}
    assert len(want & set(pairs)) >= 0.99 * len(want)
    assert forest_neighbours(spark.createDataFrame([], VECTORS)).count() == 0


def test_codes_are_ordered_and_near(spark):
    values = sorted({v * s + d for v in (0, 1, 7, 1000, 1023, 1024, 99999, 10**9, 10**12, 3 * 10**13, 10**15, 1 << 53, 1 << 62) for s in (1, -1) for d in (-1, 0, 1)})
    df = spark.createDataFrame([(v,) for v in values], "v long")
    codes = [r[0] for r in df.orderBy("v").select(quantiles.code_of(df["v"])).collect()]
    assert codes == sorted(codes) and 0 <= min(codes) and max(codes) < 1 << quantiles.LEVELS
    back = quantiles.value_of(np.array(codes))
    assert all(abs(b - v) <= quantiles.VALUE_ERROR * abs(v) for b, v in zip(back, values))


def test_digest_rank_error_also_after_merging():
    rng = np.random.default_rng(4)
    k = 200
    parts = []
    for _ in range(7):
        codes = rng.integers(0, 1 << 16, 5000) if rng.random() < 0.5 else rng.integers(30000, 30050, 5000)
        leaf, count = np.unique(codes + (1 << quantiles.LEVELS), return_counts=True)
        parts.append((codes, *quantiles.compress(np.zeros(len(leaf), np.int64), leaf, count, k)[1:]))
    node = np.concatenate([p[1] for p in parts])
    count = np.concatenate([p[2] for p in parts])
    same, back = np.unique(node, return_inverse=True)
    _, node, count = quantiles.compress(np.zeros(len(same), np.int64), same, np.bincount(back, count).astype(np.int64), k)
    everything = np.sort(np.concatenate([p[0] for p in parts]))
    n = len(everything)
    assert count.sum() == n and len(node) <= 3 * k + 64
    for q in (0.01, 0.25, 0.5, 0.9, 0.99):
        value = quantiles.quantile(np.zeros(len(node), np.int64), node, count, [q])[0, 0]
        code = int(np.flatnonzero(np.isclose(quantiles.value_of(np.arange(1 << quantiles.LEVELS)), value))[0])
        low, high = np.searchsorted(everything, code, "left"), np.searchsorted(everything, code, "right")
        assert low - quantiles.LEVELS * n / k <= q * n <= high + quantiles.LEVELS * n / k


def shop(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        row = (
            i,
            rng.choice([None, *range(300)]),
            rng.choice([None, Decimal(rng.randint(-900, 99999)) / 100]),
            rng.choice(["Shipped ", "shipped", "PENDING", "", None, "pending\t"]),
            rng.choice([None, datetime(1970, 1, 1), T0, T0 + timedelta(days=1)]),
            T0,
        )
        rows.append(row)
        if i % 20 == 0:
            rows.append((*row[:5], T0 + timedelta(days=5)))
    return rows


def test_percentiles_by_status_and_day(spark):
    rows = shop(3000)
    df = spark.createDataFrame(rows, ORDERS).selectExpr("*", "1 as node", "2 as day", "3 as _c")
    got = {(r.scope, r.day, r.status): r for r in quantiles.order_percentiles(df, q=(0.5, 0.9)).collect()}
    groups: dict = {}
    for _, _, amount, status, at, _ in {r[0]: r for r in reversed(rows)}.values():
        if amount is None:
            continue
        s = (status or "").strip().lower() or None
        d = at.date() if at and at.year > 1970 else None
        groups.setdefault(("day", d, s), []).append(float(amount))
        groups.setdefault(("all", None, s), []).append(float(amount))
    assert set(got) == set(groups)
    for key, values in groups.items():
        values.sort()
        assert got[key].n == len(values)
        exact = values[int(np.ceil(0.5 * len(values))) - 1]
        assert got[key].p50 == pytest.approx(exact, rel=0.002, abs=0.02)
    assert quantiles.order_percentiles(spark.createDataFrame([], ORDERS)).count() == 0


def test_distinct_counts(spark):
    rows = shop(4000)
    got = {(r.scope, r.day, r.status): r.estimate for r in distinct.distinct_buyers(spark.createDataFrame(rows, ORDERS)).collect()}
    users = {r[1] for r in rows if r[1] is not None}
    assert got[("all", None, None)] == pytest.approx(len(users), rel=0.05)
    shipped = {r[1] for r in rows if r[1] is not None and (r[3] or "").strip().lower() == "shipped"}
    assert got[("status", None, "shipped")] == pytest.approx(len(shipped), rel=0.05)
    assert distinct.distinct_buyers(spark.createDataFrame([], ORDERS)).count() == 0


def test_registers_of_a_range(spark):
    df = spark.createDataFrame(shop(4000), ORDERS)
    parts = distinct.buyer_registers(df)
    one = {r.status: r.estimate for r in distinct.distinct_in_range(parts, "2030-01-01", "2030-01-01").collect()}
    want = {(r.day, r.status): r.estimate for r in distinct.distinct_buyers(df).where("scope = 'day_status'").collect()}
    assert one == {s: n for (d, s), n in want.items() if d == T0.date()}
    assert all(r.within for r in distinct.distinct_bounds(df).collect())


@pytest.mark.parametrize("n", [1, 10, 3000, 12000, 60000])
def test_distinct_error_bound_and_merging(spark, n):
    df = spark.range(n).selectExpr("id", "id % 3 as part", "1 as one")
    parts = distinct.registers(df, ["part", "one"], "id")
    whole = distinct.estimates(distinct.merge(parts, ["one"]), ["one"]).first()
    assert abs(whole.estimate - n) <= 4 * distinct.STANDARD_ERROR * n + 0.5
    direct = distinct.estimates(distinct.registers(df, ["one"], "id"), ["one"]).first()
    assert direct.estimate == whole.estimate
