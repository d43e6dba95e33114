"""Rolling totals, change replay and the work ledger against brute force and odd input."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from larkspur.operators import ledger
from larkspur.operators.changes import current_state, replay
from larkspur.operators.ledger import StaleLease, WorkLedger, item_states, open_items
from larkspur.operators.rolling import rolling_totals

ORDERS = "id long, user_id long, amount decimal(12,2), status string, placed_at timestamp_ntz, loaded_at timestamp_ntz"
EVENTS = "arrival_id long, arrived_at timestamp_ntz, origin int, lsn long, puts array<struct<k:string,v:string>>, deletes array<string>"
RUNS = "run_id long, replica_id int, origin int, started_at timestamp_ntz, from_lsn long, lsn long, state string, logged_at timestamp_ntz"
T0 = datetime(2030, 1, 1)


def orders(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = rng.choice([1, 1, 1, 2, 3, None])
        at = rng.choice([None, datetime(1970, 1, 1), *[T0 + timedelta(days=rng.randint(0, 60), seconds=rng.choice([0, 86399]))] * 9])
        amount = rng.choice([None, *[Decimal(rng.randint(-500, 9000)) / 100] * 6])
        row = (i, user, amount, "x", at, T0 + timedelta(minutes=i))
        rows.append(row)
        if rng.random() < 0.1:
            rows.append((*row[:5], T0 + timedelta(days=99)))
    rng.shuffle(rows)
    return rows


def brute_rolling(rows, periods):
    once = {}
    for r in rows:
        once.setdefault(r[0], r)
    days: dict = {}
    for _, user, amount, _, at, _ in once.values():
        if user is None or at is None or at.year == 1970:
            continue
        days.setdefault(user, {}).setdefault(at.date(), []).append(amount)
    out = {}
    for user, by_day in days.items():
        day, first = min(by_day), min(by_day)
        while day <= max(by_day):
            cells = []
            for p in periods:
                found = [a for k in range(p) for a in by_day.get(day - timedelta(days=k), [])]
                known = [a for a in found if a is not None]
                total = float(sum(known, Decimal(0)))
                cells += [len(found), total, total / len(known) if known else None, total / min(p, (day - first).days + 1)]
            out[(user, day)] = cells
            day += timedelta(days=1)
    return out


def test_rolling_matches_brute_force(spark):
    rows = orders(1, 400)
    got = rolling_totals(spark.createDataFrame(rows, ORDERS), periods=(7, 30)).collect()
    want = brute_rolling(rows, (7, 30))
    assert {(r[0], r[1]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert list(r[2:]) == pytest.approx(want[(r[0], r[1])])


def test_rolling_odd_input(spark):
    empty = spark.createDataFrame([], ORDERS)
    assert rolling_totals(empty).count() == 0
    clash = spark.createDataFrame([(1, 5, Decimal("2.50"), "x", T0, T0)], ORDERS).selectExpr("*", "1 as day", "2 as _e", "3 as _c")
    row = rolling_totals(clash, periods=(2,)).collect()
    assert [tuple(r) for r in row] == [(5, T0.date(), 1, 2.5, 2.5, 2.5)]


def events(seed: int, n: int):
    rng = random.Random(seed)
    sets = {}
    for origin in (1, 2):
        for lsn in rng.sample(range(1, 3 * n), n):
            keys = [f"k{rng.choice([0, 0, 0, *range(1, 9)])}" for _ in range(rng.randint(0, 4))]
            puts = [(k, f"{lsn}.{j}") for j, k in enumerate(keys)]
            sets[(origin, lsn)] = (puts if puts or rng.random() < 0.5 else None, rng.choice([None, [], [f"k{rng.randint(0, 9)}"]]))
    rows = [(o, lsn, *v) for (o, lsn), v in sets.items()]
    rows += rng.choices(rows, k=n // 3)
    rng.shuffle(rows)
    out = [(i, T0 + timedelta(seconds=i), *r) for i, r in enumerate(rows)]
    return [*out, (9999, T0, 1, None, [("k1", "x")], None), (9998, T0, 1, 10**9, [(None, "x")], [None])], sets


def test_state_matches_brute_force(spark):
    rows, sets = events(2, 120)
    want: dict = {}
    for (origin, lsn), (puts, deletes) in sorted(sets.items(), key=lambda x: x[0][1]):
        for k in deletes or []:
            want.pop((origin, k), None)
        for k, v in puts or []:
            want[(origin, k)] = (v, lsn)
    df = spark.createDataFrame(rows, EVENTS).repartition(7)
    got = {(r.origin, r.k): (r.v, r.lsn) for r in current_state(df).collect()}
    assert got == want
    short = {(r.origin, r.k): r.lsn for r in current_state(df, with_value=False).collect()}
    assert short == {k: v[1] for k, v in want.items()}


def test_state_of_nothing(spark):
    assert current_state(spark.createDataFrame([], EVENTS)).count() == 0


def test_partial_updates_keep_other_columns(spark):
    ops = spark.createDataFrame(
        [
            ("a", 1, True, "x", 1, "extra"),
            ("a", 3, True, None, 3, "extra"),
            ("a", 2, True, "y", None, "extra"),
            ("b", 1, True, "x", 1, None),
            ("b", 2, False, None, None, None),
            ("b", 3, True, None, 9, None),
            ("c", 5, True, "z", 1, None),
            ("c", 6, False, None, None, None),
            (None, 1, True, "n", 1, None),
        ],
        "k string, s long, put boolean, p string, q int, _seq string",
    ).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in replay(ops, ["k"], "s", "put", ["p", "q"]).collect()}
    assert got == {"a": ("y", 3, 3), "b": (None, 9, 3), None: ("n", 1, 1)}


def test_replay_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows, _ = events(5, 90)
        df = spark.createDataFrame(rows, EVENTS)
        small = sorted(map(tuple, current_state(df).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == sorted(map(tuple, current_state(df).collect()))


def test_open_items_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, T0 + timedelta(minutes=rng.randint(0, 500)), o, rng.choice([None, *range(1, 400)]), None, None) for i in range(900) for o in (1, 2)]
    runs = []
    for run in range(60):
        origin, replica, lo = rng.choice([1, 2]), rng.choice([7, 8]), rng.randint(0, 390)
        started = T0 + timedelta(minutes=rng.randint(0, 500))
        end, state = lo + rng.choice([0, 5, 40, 390]), rng.choice(["ok", "ok", "failed", "rolled_back"])
        log = [(run, replica, origin, started, lo, lo, "running", started), (run, replica, origin, started, lo, end, state, started + timedelta(minutes=1))]
        if state == "rolled_back":
            log.insert(1, (run, replica, origin, started, lo, end, "ok", started + timedelta(seconds=30)))
        runs += log + log[:1]
    rng.shuffle(runs)
    monkeypatch.setattr(ledger, "BUCKET", 4)
    monkeypatch.setattr(ledger, "SPAN", 4)
    got = {tuple(r) for r in open_items(spark.createDataFrame(items, EVENTS), spark.createDataFrame(runs, RUNS)).collect()}
    last: dict = {}
    for r in runs:
        if r[0] not in last or r[7] > last[r[0]][7]:
            last[r[0]] = r
    first: dict = {}
    for _, at, o, lsn, *_ in items:
        if lsn is not None:
            first[(o, lsn)] = min(at, first.get((o, lsn), at))
    want = {
        (o, rep, lsn)
        for (o, lsn), at in first.items()
        for rep in {r[1] for r in runs if r[2] == o}
        if not any(r[6] == "ok" and r[1] == rep and r[2] == o and r[4] < lsn <= r[5] and at <= r[3] for r in last.values())
    }
    assert got == want


def test_open_items_of_nothing(spark):
    no_items, no_runs = spark.createDataFrame([], EVENTS), spark.createDataFrame([], RUNS)
    one = spark.createDataFrame([(1, T0, 1, 5, None, None)], EVENTS)
    assert open_items(no_items, no_runs).count() == 0
    assert open_items(one, no_runs).count() == 0
    odd = spark.createDataFrame([(None, 3, 1, None, None, None, None, None)], RUNS)
    assert [tuple(r) for r in open_items(one, odd).collect()] == [(1, 3, 5)]


def test_item_states(spark):
    items = spark.createDataFrame([(i, T0, 1, i, None, None) for i in range(1, 11)], EVENTS)
    at = T0 + timedelta(hours=1)
    runs = spark.createDataFrame(
        [(1, 7, 1, at, 0, 4, "ok", at), (2, 7, 1, at + timedelta(minutes=5), 6, 6, "running", at + timedelta(minutes=5))], RUNS
    )
    row = item_states(items, runs, "2030-01-01 01:30:00").first()
    assert (row.pending, row.leased, row.done) == (2, 4, 4)
    expired = item_states(items, runs, "2030-01-01 05:00:00").first()
    assert (expired.pending, expired.leased, expired.done) == (6, 0, 4)


def test_ranges_of_any_length(spark):
    """A run over ten billion LSNs is cut into few wide buckets beside narrow ones."""
    items = spark.createDataFrame([(i, T0, 1, n, None, None) for i, n in enumerate([1, 5, 300, 10**9, 9 * 10**9, 10**10, 10**10 + 1])], EVENTS)
    at = T0 + timedelta(hours=1)
    runs = spark.createDataFrame(
        [(1, 7, 1, at, 3, 10**10, "ok", at), (2, 7, 1, at, 10**10, 10**10 + 5, "failed", at), (3, 8, 1, at, 0, 5, "ok", at)], RUNS
    )
    assert ledger._cut_ranges(spark.createDataFrame([(1, 7, 3, 10**10, at)], "origin int, replica_id int, _lo long, _hi long, _at timestamp_ntz")).count() < 70
    got = sorted(tuple(r) for r in open_items(items, runs).collect())
    assert got == [(1, 7, 1), (1, 7, 10**10 + 1), *[(1, 8, n) for n in (300, 10**9, 9 * 10**9, 10**10, 10**10 + 1)]]


def test_ledger_leases_and_fences(tmp_path, spark):
    book = WorkLedger(spark, str(tmp_path), lease_seconds=10)
    first = book.lease("a", now=0)
    assert first and book.lease("a", now=5) is None
    second = book.lease("a", now=11)
    assert second and second.token > first.token
    with pytest.raises(StaleLease):
        book.finish(first)
    book.finish(second)
    assert book.state("a", 12)[0] == "done" and book.lease("a", 99) is None
    assert book.process("b", spark.range(3), now=0) and not book.process("b", spark.range(9), now=1)
    assert spark.read.parquet(book.path("b")).count() == 3


def test_ledger_keeps_done_output_from_a_late_holder(tmp_path, spark):
    book = WorkLedger(spark, str(tmp_path), lease_seconds=10)

    class Late:
        """A frame that takes so long that another holder is done before it writes."""

        write = property(lambda self: self)

        def mode(self, mode):
            return self

        def parquet(self, path):
            assert book.process("c", spark.range(3), now=11)
            spark.range(9).write.mode("overwrite").parquet(path)

    with pytest.raises(StaleLease):
        book.process("c", Late(), now=0)
    assert spark.read.parquet(book.path("c")).count() == 3
