"""Current state of a keyed table from a feed of inserts, updates and deletes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def group_starts(batch: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True where the key differs from the row before (NULL equals NULL)."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        col = batch.column(k).combine_chunks()
        a, b = col.slice(1), col.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = col.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differ.astype(bool) | (nulls[1:] != nulls[:-1])
    return new


def _last_true(flag: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each group the last row with ``flag``, -1 where there is none."""
    at = np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))[ends]
    return np.where(at >= starts, at, -1)


class _Replay:
    """State machine over rows sorted by key and sequence.

    Per key it holds the last delete and, for each column, the last put after it
    that set the column; whatever those overrule, or what repeats a sequence already
    applied, falls away. ``combine`` returns the rows that still matter, so it may run
    before a shuffle as well as after; ``finish`` returns the state itself.
    """

    def __init__(self, keys: Sequence[str], columns: Sequence[str]):
        self.keys, self.columns = list(keys), list(columns)

    def _settle(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        starts = np.flatnonzero(group_starts(t, self.keys))
        ends = np.append(starts[1:], t.num_rows) - 1
        put = t.column("_put").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        deleted = _last_true(~put, ends, starts)
        floor = np.maximum(deleted + 1, starts)
        live = _last_true(put, ends, floor)
        sets = []
        for c in self.columns:
            given = ~t.column(c).combine_chunks().is_null().to_numpy(zero_copy_only=False)
            sets.append(_last_true(put & given, ends, floor))
        return starts, ends, deleted, live, sets

    def combine(self, t: pa.Table) -> pa.Table:
        _, _, deleted, live, sets = self._settle(t)
        keep = np.unique(np.concatenate([deleted, live, *sets]))
        return t.take(pa.array(keep[keep >= 0]))

    def finish(self, t: pa.Table) -> pa.Table:
        _, _, _, live, sets = self._settle(t)
        alive = live >= 0
        base = t.take(pa.array(live[alive]))
        out = {k: base.column(k) for k in self.keys}
        for c, at in zip(self.columns, sets):
            index = pa.array(at[alive], mask=at[alive] < 0)
            out[c] = t.column(c).combine_chunks().take(index)
        out["_seq"] = base.column("_seq")
        return pa.table(out)

    def stream(self, batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        """Rows of a key may cross batches: the open key's rows are carried on, already
        combined, so what is held is never more than one batch and one key's state."""
        carry: pa.Table | None = None
        act = self.finish if last else self.combine
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            at = int(np.flatnonzero(group_starts(t, self.keys))[-1])
            if at:
                yield from act(t.slice(0, at)).combine_chunks().to_batches()
            carry = self.combine(t.slice(at))
        if carry is not None and carry.num_rows:
            yield from act(carry).combine_chunks().to_batches()


def replay(
    ops: DataFrame, keys: Sequence[str], seq: str, put: str, columns: Sequence[str] = (), position: str | None = None
) -> DataFrame:
    """State of each key that is live after all its operations.

    ``ops`` has one row an operation: the ``keys``, the sequence ``seq`` (bigint),
    ``put`` (boolean: false is a delete) and the ``columns`` it sets; NULL in a column
    leaves it as it was (a partial update). Operations apply in order of ``seq``,
    within one ``seq`` deletes before puts and puts by ``position``. Order of arrival
    and repeats don't matter. Returns ``keys``, ``columns`` and ``seq`` of the last put.

    Rows without ``seq`` or ``put`` carry no change. A NULL key is a key of its own.
    Other columns are ignored, whatever their names; no rows give no state.

    Plan: each input partition is sorted and replayed where it lies, which leaves a
    few rows a key however hot it is; these are shuffled by key, sorted by sequence
    and replayed once more.
    """
    kept = ops.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(seq).cast("bigint").alias("_seq"),
        F.col(put).alias("_put"),
        (F.col(position) if position else F.lit(0)).cast("int").alias("_pos"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)],
    ).where("_seq is not null and _put is not null")
    inner = [f"_k{i}" for i in range(len(keys))]
    machine = _Replay(inner, [f"_c{i}" for i in range(len(columns))])
    order = [*inner, "_seq", "_put", "_pos"]
    combined = kept.sortWithinPartitions(*order).mapInArrow(lambda it: machine.stream(it, False), kept.schema)
    fields = [f for f in kept.schema.fields if f.name not in ("_put", "_pos")]
    by_name = {f.name: f for f in fields}
    final = T.StructType([by_name[n] for n in (*inner, *machine.columns, "_seq")])
    state = (
        combined.repartition(*inner).sortWithinPartitions(*order).mapInArrow(lambda it: machine.stream(it, True), final)
    )
    names = [*keys, *columns, seq]
    return state.toDF(*names)


def write_set_operations(events: DataFrame, with_value: bool = True) -> DataFrame:
    """One row for each delete and put of a feed of write-sets (``origin``, ``lsn``,
    ``puts`` array<struct<k,v>>, ``deletes`` array<string>): ``origin``, ``k``, ``lsn``,
    ``put``, ``pos`` and, if wanted, ``v``. NULL arrays, NULL entries, NULL keys and
    write-sets without an LSN carry no change."""
    known = events.where("lsn is not null")
    value = [F.col("x.v").alias("v")] if with_value else []
    nothing = [F.lit(None).cast("string").alias("v")] if with_value else []
    puts = known.select("origin", "lsn", F.posexplode("puts").alias("pos", "x")).select(
        "origin", F.col("x.k").alias("k"), "lsn", F.lit(True).alias("put"), "pos", *value
    )
    deletes = known.select("origin", "lsn", F.posexplode("deletes").alias("pos", "k")).select(
        "origin", "k", "lsn", F.lit(False).alias("put"), "pos", *nothing
    )
    return puts.unionByName(deletes).where("k is not null")


def current_state(events: DataFrame, with_value: bool = True) -> DataFrame:
    """Key/value state of every origin: ``origin``, ``k``, (``v``,) ``lsn``. A put of a
    NULL value is live with a NULL value only if the key never had one since its last
    delete (NULL leaves a column as it was)."""
    ops = write_set_operations(events, with_value)
    return replay(ops, ["origin", "k"], "lsn", "put", ["v"] if with_value else [], "pos")
