"""The k nearest vectors of every vector, by a forest of hash prefixes.

Each tree has a sequence of random hyperplanes, which gives every vector a long string
of bits; the strings of a tree stand in a sorted array. A vector descends in every tree
to the rows that share its longest prefix and then ascends, in all trees in step, until
their rows together are candidates enough; how many are enough is fitted to a stated
recall on some vectors whose neighbours are found exactly.

Over a cluster the forest has two storeys. An index of more than ``UNIT`` rows is cut, in
each of a few coarse trees, into units of about that many rows by the first bits of the
strings; a unit is one task, which holds its vectors once and grows the trees over them.
Vectors are so shuffled once a coarse tree, not once a tree, and once only for indexes
that are one unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut, shuffle_width

L2, COSINE, INNER = 0, 1, 2
GROUP = ["index_id", "metric", "dim"]
KEY = [*GROUP, "_tree", "_unit"]
#: Rows of a unit.
UNIT = 1 << 16
#: Rows of a large index that its coarse trees are fitted on.
FIT_ROWS = 2000
#: Models of large indexes that go to the executors as a variable (each has centre and
#: unit borders, about 4 dim + 24 units bytes); beyond, they are joined to the rows.
MODELS = 10_000
BITS = 40
DATA, ASK, BOTH = 0, 1, 2


def usable(df: DataFrame) -> DataFrame:
    """Rows with a node, a vector of the stated length, all finite and not all zero."""
    v = F.col("vectors")
    low, high = F.array_min(v), F.array_max(v)  # NaN is above infinity
    return df.select("vec_id", *GROUP, v.cast("array<float>").alias("vectors"), "node_key").where(
        F.col("node_key").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.col("metric").isin(L2, COSINE, INNER)
        & F.col("index_id").isNotNull()
        & (F.size(v) == F.col("dim"))
        & (F.size(F.array_compact(v)) == F.col("dim"))
        & (high < F.lit(float("inf")))
        & (low > F.lit(float("-inf")))
        & ((low != 0) | (high != 0))
    ).drop("node_key")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # the norm of huge or tiny values would overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)).astype(np.float32)[:, None]


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))


def _sides(metric: int, x: np.ndarray, centre: np.ndarray | None, norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors to hash as rows and as queries, and the centre taken from them.

    Largest inner product as largest cosine: rows are lengthened to one norm by a further
    dimension, in which a query is 0. Taking the rows' mean from them leaves the order of
    a query's products as it is and makes the bits even. For the other metrics both sides
    are the same."""
    if metric == L2:
        centre = x.mean(0) if centre is None else centre
        return x - centre, x - centre, centre
    unit = _unit(x)
    if metric == COSINE:
        centre = unit.mean(0) if centre is None else centre
        return unit - centre, unit - centre, centre
    share = np.minimum(_length(x) / max(norm, 1e-30), 1).astype(np.float32)[:, None]
    rows = np.hstack([unit * share, np.sqrt(1 - share * share)])
    asks = np.hstack([unit, np.zeros_like(share)])
    centre = np.concatenate([rows.mean(0), asks.mean(0)]) if centre is None else centre
    return rows - centre[: rows.shape[1]], asks - centre[rows.shape[1] :], centre


def _strings(x: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """(trees, rows) of bit strings, the first hyperplane in the highest bit."""
    weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    out = np.empty((trees, len(x)), np.int64)
    for start in range(0, len(x), 8192):
        some = x[start : start + 8192]
        bits = (some @ planes).reshape(len(some), trees, BITS) > 0
        out[:, start : start + 8192] = (bits @ weight).T
    return out


def _planes(seed: int, key: tuple, trees: int, storey: int) -> np.ndarray:
    rng = np.random.default_rng([seed, storey, key[0] & 0xFFFFFFFF, key[2]])
    return rng.standard_normal((key[2] + (key[1] == INNER), trees * BITS)).astype(np.float32)


# --- the upper storey: units of large indexes -----------------------------------------


def _borders(place: np.ndarray, rows: float) -> tuple[np.ndarray, np.ndarray]:
    """First string of each unit, and into how many parts a unit is cut by hash because
    its sample can't be told apart by bits; ``rows`` is what a sample row stands for."""
    place = np.sort(place)
    starts, parts = [], []

    def grow(lo: int, hi: int, first: int, bit: int) -> None:
        if (hi - lo) * rows <= UNIT or bit < 0 or place[lo] == place[hi - 1]:
            starts.append(first)
            parts.append(max(1, int(np.ceil((hi - lo) * rows / UNIT / 2))))
            return
        half = first + (1 << bit)
        cut = int(np.searchsorted(place, half))
        for a, b, f in ((lo, cut, first), (cut, hi, half)):
            if b > a:
                grow(a, b, f, bit - 1)
    grow(0, len(place), 0, BITS - 1)
    starts[0] = 0
    return np.array(starts, np.int64), np.array(parts, np.int64)


def _models(points: DataFrame, large: DataFrame, coarse: int, seed: int) -> DataFrame:
    """For each large index its centre, largest norm (over all its rows) and the borders of
    its units in each coarse tree, fitted on about FIT_ROWS rows picked by hash."""
    length = F.sqrt(F.aggregate("vectors", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    wide = F.when(F.col("metric") == INNER, length).otherwise(F.lit(0.0))
    total = points.join(large.select(*GROUP), GROUP).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.max(wide).alias("norm"))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) * F.col("n") < F.lit(FIT_ROWS << 40).cast("decimal(38,0)")
    sample = points.join(total, GROUP).where(share)

    def fit(key, pdf):
        import pandas as pd

        key = tuple(int(v) for v in key)
        x = np.stack(pdf["vectors"].to_numpy()).astype(np.float32)
        norm, n = float(pdf["norm"][0]), int(pdf["n"][0])
        rows, _, centre = _sides(key[1], x, None, norm)
        found = [_borders(p, n / len(x)) for p in _strings(rows, _planes(seed, key, coarse, 0), coarse)]
        return pd.DataFrame(
            {GROUP[0]: [key[0]], GROUP[1]: [key[1]], GROUP[2]: [key[2]], "centre": [centre.astype(np.float32)], "norm": [norm],
             "starts": [[s for s, _ in found]], "parts": [[p for _, p in found]]}
        )

    return sample.groupBy(*GROUP).applyInPandas(
        fit, "index_id int, metric int, dim int, centre array<float>, norm double, starts array<array<long>>, parts array<array<long>>"
    )


def _router(models: dict[tuple, tuple] | None, coarse: int, seed: int):
    """Names the units that each row goes to: one for rows of indexes without a model, and
    for others one in each coarse tree, or two where an inner product's query string
    lies in another unit than its row string."""

    def places(key: tuple, ids: np.ndarray, x: np.ndarray, model: tuple) -> tuple[np.ndarray, ...]:
        centre, norm, starts, parts = model
        rows, asks, _ = _sides(key[1], x, centre, norm)
        planes = _planes(seed, key, coarse, 0)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)

        def add(at: np.ndarray, tree: int, unit: np.ndarray, role: int, place: np.ndarray) -> None:
            for o, v in zip(out, (at, np.full(len(at), tree), unit[at], np.full(len(at), role), place[at])):
                o.append(v)

        own, asked = _strings(rows, planes, coarse), _strings(asks, planes, coarse) if key[1] == INNER else None
        for t in range(coarse):
            def unit_of(place: np.ndarray) -> np.ndarray:
                u = np.searchsorted(starts[t], place, "right") - 1
                return u << 20 | (salt % parts[t][u].astype(np.uint64)).astype(np.int64)

            unit = unit_of(own[t])
            every = np.arange(len(ids))
            if asked is None:
                add(every, t, unit, BOTH, own[t])
                continue
            other = unit_of(asked[t])
            same = unit == other
            add(every[same], t, unit, BOTH, own[t])
            add(every[~same], t, unit, DATA, own[t])
            add(every[~same], t, other, ASK, asked[t])
        return tuple(np.concatenate(o) for o in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[tuple, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in GROUP], 1)
            for key in np.unique(keys, axis=0):
                part = batch.take(pa.array(np.flatnonzero((keys == key).all(1))))
                key = tuple(int(v) for v in key)
                if models is not None:
                    model = models.get(key)
                else:
                    if key not in joined and part.column("starts").null_count == 0:
                        m = part.slice(0, 1).select(["centre", "norm", "starts", "parts"]).to_pylist()[0]
                        joined[key] = _model(m["centre"], m["norm"], m["starts"], m["parts"])
                    model = joined.get(key)
                ids = part.column("vec_id").to_numpy()
                if model is None:
                    at = np.arange(len(ids))
                    tree, unit, role, place = (np.full(len(ids), v) for v in (0, 0, BOTH, 0))
                else:
                    at, tree, unit, role, place = places(key, ids, _matrix(part.column("vectors"), key[2]), model)
                part = part.select(["vec_id", *GROUP, "vectors"]).take(pa.array(at))
                cols = [*part.columns, pa.array(tree, pa.int32()), pa.array(unit, pa.int64()), pa.array(role, pa.int32()), pa.array(place, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", *GROUP, "vectors", "_tree", "_unit", "_role", "_place"])

    return run


def _model(centre, norm, starts, parts) -> tuple:
    return np.array(centre, np.float32), norm, [np.array(s, np.int64) for s in starts], [np.array(p, np.int64) for p in parts]


# --- the lower storey: a forest over the rows of a unit -------------------------------


def _exact(metric: int, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of q (n, d) to c (n, m, d) in double precision, the same for a pair
    whatever unit it is met in."""
    q, c = q.astype(np.float64)[:, None, :], c.astype(np.float64)
    if metric == L2:
        d = c - q
        return (d * d).sum(2)
    dot = (c * q).sum(2)
    if metric == INNER:
        return -dot
    d = 1 - dot / (np.sqrt((q * q).sum(2)) * np.sqrt((c * c).sum(2)))
    return np.where(d < 1e-12, 0.0, d)  # equal directions, not rounding, decide ties


def _smallest(near: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m smallest values of each row. They lie in the m groups of columns
    with the smallest minima, so of a wide row only these are looked through."""
    rows, cols = near.shape
    if cols <= m:
        return np.broadcast_to(np.arange(cols), near.shape)
    width = 32 if cols < 16384 else 128
    g = cols // width
    if g <= 2 * m:
        return np.argpartition(near, m - 1, axis=1)[:, :m]
    least = near[:, : g * width].reshape(rows, width, g).min(1)
    groups = np.argpartition(least, m - 1, axis=1)[:, :m]
    at = (groups[:, :, None] + np.arange(width) * g).reshape(rows, -1)
    if g * width < cols:
        at = np.hstack([at, np.broadcast_to(np.arange(g * width, cols), (rows, cols - g * width))])
    top = np.argpartition(np.take_along_axis(near, at, 1), m - 1, axis=1)[:, :m]
    return np.take_along_axis(at, top, 1)


class _Forest:
    """Sorted arrays of strings over the rows ``data`` of one unit, searched for ``asks``."""

    #: Cells of distances held at once.
    CELLS = 1 << 20

    def __init__(self, key: tuple, ids: np.ndarray, x: np.ndarray, roles: np.ndarray, k: int, trees: int, target: float, seed: int):
        self.key, self.metric, self.ids, self.x, self.k = key, key[1], ids, x, k
        self.data = np.flatnonzero(roles != ASK)
        self.asks = np.flatnonzero(roles != DATA)
        self.trees, self.target, self.seed = trees, target, seed
        self.n = len(self.data)
        self.m = 2 * k + 2  # copies may tie, and these distances are in single precision
        with np.errstate(over="ignore", invalid="ignore"):
            if self.metric == L2:
                # |r|^2 - 2 q r orders as the distance does; a further dimension adds |r|^2.
                p = x - x.mean(0)
                self.points = np.hstack([p, np.einsum("ij,ij->i", p, p)[:, None]])
                self.queries = np.hstack([-2 * p, np.ones((len(x), 1), np.float32)])
            else:
                self.points = _unit(x) if self.metric == COSINE else x
                self.queries = -self.points
            # Products of huge values overflow, and then may not be numbers.
            self.huge = not float(np.abs(self.points).max()) < 1e17
        self.place_of = np.full(len(x), -1, np.int64)
        self.place_of[self.data] = np.arange(self.n)

    def near(self, asks: np.ndarray, rows: np.ndarray, itself: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``asks`` the m nearest of ``rows`` (both numbers of x) and how near;
        ``itself``: column of the query among them, or -1."""
        return self._nearest(asks, rows, self.points[rows], itself)

    def _nearest(self, asks: np.ndarray, rows: np.ndarray, points: np.ndarray, itself: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            near = self.queries[asks] @ points.T
        if self.huge:
            np.nan_to_num(near, copy=False, nan=np.float32(3e38), posinf=3e38, neginf=-3e38)
        there = np.flatnonzero(itself >= 0)
        near[there, itself[there]] = np.inf
        top = _smallest(near, self.m)
        return rows[top], np.take_along_axis(near, top, 1)

    def whole(self, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Against all rows."""
        step = max(16, self.CELLS // self.n)
        points = self.points[self.data]
        found = [self._nearest(a, self.data, points, self.place_of[a]) for a in np.split(asks, np.arange(step, len(asks), step))]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def plant(self) -> None:
        norm = float(_length(self.x[self.data]).max()) if self.metric == INNER else 0.0
        rows, asks, _ = _sides(self.metric, self.x, None, norm)
        planes = _planes(self.seed, self.key, self.trees, 1)
        self.row_place = _strings(rows[self.data], planes, self.trees)
        self.ask_place = self.row_place if self.metric != INNER and len(self.asks) == self.n else _strings(asks[self.asks], planes, self.trees)
        self.order = np.argsort(self.row_place, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.row_place, self.order, 1)

    def node(self, tree: int, place: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a tree's sorted array that share the first ``level`` bits."""
        shift = BITS - np.asarray(level, np.int64)
        first = place >> shift << shift
        array = self.sorted[tree]
        return np.searchsorted(array, first), np.searchsorted(array, first + (np.int64(1) << shift))

    def within(self, place: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        """Rows that all trees together have at a level."""
        total = np.zeros(place.shape[1], np.int64)
        for t in range(self.trees):
            lo, hi = self.node(t, place[t], level)
            total += hi - lo
        return total

    def enough(self) -> int | None:
        """Candidates that a query has to ascend for, or None if a pass over the whole unit
        costs no more. Fitted on up to 256 queries: the fewest (doubling from 512) with
        which the stated share of their exact neighbours is met."""
        picked = np.unique(np.linspace(0, len(self.asks) - 1, 256).astype(np.int64))
        found, near = self.whole(self.asks[picked])
        kth = np.argsort(near, axis=1)[:, : self.k]
        found, real = np.take_along_axis(found, kth, 1), np.isfinite(np.take_along_axis(near, kth, 1))
        place = self.ask_place[:, picked]
        other = self.row_place[:, self.place_of[found]]
        apart = place[:, :, None] ^ other
        shared = BITS - np.ceil(np.log2(apart.min(0) + 1.0)).astype(np.int64)  # bits in common in the best tree
        counts = np.stack([self.within(place, x) for x in range(BITS + 1)])
        need = 512
        while need < self.n / 2:
            level = (counts >= need).sum(0) - 1
            if (shared >= level[:, None])[real].mean() >= self.target:
                return need
            need *= 2
        return None

    def levels(self, need: int) -> np.ndarray:
        """For each query the longest prefix at which the trees have ``need`` rows."""
        low, high = np.zeros(len(self.asks), np.int64), np.full(len(self.asks), BITS, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = self.within(self.ask_place, middle) >= need
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """(asks, k) of ids and exact distances; infinite where there are fewer rows."""
        need = None
        if self.n > 2048:
            self.plant()
            need = self.enough()
        if need is None:
            found, near = self.whole(self.asks)
        else:
            level = self.levels(need)
            found = np.zeros((len(self.asks), self.trees, self.m), np.int32)
            near = np.full(found.shape, np.inf, np.float32)
            for t in range(self.trees):
                lo, hi = self.node(t, self.ask_place[t], level)
                rank = np.empty(self.n, np.int64)
                rank[self.order[t]] = np.arange(self.n)
                own = self.place_of[self.asks]
                at = np.where(own >= 0, rank[own], -1)
                queue = np.lexsort((hi, lo))
                cut = np.flatnonzero((np.diff(lo[queue]) != 0) | (np.diff(hi[queue]) != 0)) + 1
                for group in np.split(queue, cut):
                    a, b = int(lo[group[0]]), int(hi[group[0]])
                    if a == b:
                        continue
                    rows = self.data[self.order[t, a:b]]
                    step = max(16, self.CELLS // (b - a))
                    for some in np.split(group, np.arange(step, len(group), step)):
                        itself = np.where((at[some] >= a) & (at[some] < b), at[some] - a, -1)
                        f, d = self.near(self.asks[some], rows, itself)
                        found[some, t, : f.shape[1]], near[some, t, : f.shape[1]] = f, d
            found, near = found.reshape(len(self.asks), -1), near.reshape(len(self.asks), -1)
        return self.settle(found, near)

    def settle(self, found: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row once, then the k nearest by exact distance and id."""
        ids, dists = [], []
        for start in range(0, len(self.asks), 2048):
            asks, f, d = self.asks[start : start + 2048], found[start : start + 2048], near[start : start + 2048]
            order = np.argsort(f, axis=1, kind="stable")
            f, d = np.take_along_axis(f, order, 1), np.take_along_axis(d, order, 1)
            # Of the places of one row the nearest stands; empty places are infinite.
            same = f[:, 1:] == f[:, :-1]
            if same.any():
                repeat = np.zeros(f.shape, bool)
                repeat[:, 1:] = same & np.isfinite(d[:, :-1])
                d = np.where(repeat, np.inf, d)
            if f.shape[1] > 2 * self.m:
                top = np.argpartition(d, 2 * self.m - 1, axis=1)[:, : 2 * self.m]
                f, d = np.take_along_axis(f, top, 1), np.take_along_axis(d, top, 1)
            with np.errstate(over="ignore", invalid="ignore"):
                exact = _exact(self.metric, self.x[asks], self.x[f])
            exact = np.where(np.isfinite(d), exact, np.inf)
            own = self.ids[f]
            exact[own == self.ids[asks][:, None]] = np.inf
            order = np.lexsort((own, exact), axis=1)[:, : self.k]
            ids.append(np.take_along_axis(own, order, 1))
            dists.append(np.take_along_axis(exact, order, 1))
        return np.concatenate(ids), np.concatenate(dists)


def _searcher(k: int, trees: int, target: float, seed: int):
    def search(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = t.column("vec_id").to_numpy()
        x = _matrix(t.column("vectors").combine_chunks(), key[2])
        forest = _Forest(key, ids, x, t.column("_role").to_numpy(), k, trees, target, seed)
        if not len(forest.asks):
            return
        asked = ids[forest.asks]
        if not forest.n:
            nbr, dist = np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0))
        else:
            nbr, dist = forest.search()
        ok = np.isfinite(dist)
        sizes = np.append(0, ok.sum(1).cumsum()).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(dist[ok]), pa.array(nbr[ok])], ["d", "id"])
        out = pa.RecordBatch.from_arrays([pa.array(asked), pa.ListArray.from_arrays(pa.array(sizes), pairs)], names=["vec_id", "near"])
        yield from (out.slice(i, 8192) for i in range(0, len(asked), 8192))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, key = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            cols = np.stack([t.column(c).to_numpy() for c in KEY], 1)
            edges = np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1
            for lo, hi in zip(np.append(0, edges), np.append(edges, len(cols))):
                own = tuple(int(v) for v in cols[lo])
                # A unit far beyond its planned size is searched in runs of its strings.
                if held and (own != key or rows > 4 * UNIT):
                    yield from search(key, pa.concat_tables(held))
                    held, rows = [], 0
                key = own
                held.append(t.slice(int(lo), int(hi - lo)))
                rows += int(hi - lo)
        if held:
            yield from search(key, pa.concat_tables(held))

    return run


def forest_neighbours(
    df: DataFrame, k: int = 5, trees: int = 8, coarse: int = 3, target: float = 0.995, seed: int = 7
) -> DataFrame:
    """The ``k`` nearest usable vectors of every usable vector of the same index, by its
    metric: 0 squared L2, 1 cosine distance, 2 negative inner product.

    Columns: ``vec_id`` and ``near``, an array of (d, id) by distance, equal distances by
    the smaller id. Vectors that are NULL, of another length than ``dim``, not finite,
    all zero or without a node take no part. A vector alone in its index has an empty
    list, no input no rows; columns beyond those of the table are ignored.

    Equal vectors: of a class of copies the k + 1 smallest ids stand in the forest, as
    no list can hold others; further copies take over the list of the smallest one.
    That is exact and keeps a class of any size from filling a unit.

    ``target`` is the share of exact neighbours that the ascent within a unit is fitted
    to; where half the unit would have to be looked through, all of it is, which is
    exact. Indexes of up to ``UNIT`` rows are one unit. Of larger ones a neighbour is
    missed if it shares a unit in none of the ``coarse`` trees (README).
    """
    spark = df.sparkSession
    points = usable(df)
    same = [*GROUP, "_h1", "_h2"]
    marked = points.withColumns({"_h1": F.xxhash64("vectors"), "_h2": F.hash("vectors")})
    crowded = marked.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k + 1).select(*same)
    members = marked.select("vec_id", *same).join(crowded, same)
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    classes = first.groupBy(*same).agg(
        F.min("vec_id").alias("_first"), F.max("vec_id").alias("_last"), F.collect_list("vec_id").alias("_own")
    )
    kept = (
        marked.join(classes.select(*same, "_last"), same, "left")
        .where(F.col("_last").isNull() | (F.col("vec_id") <= F.col("_last")))
        .select("vec_id", *GROUP, "vectors")
    )
    large = df.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > UNIT + UNIT // 4)
    n_large = large.count()
    schema = "vec_id long, index_id int, metric int, dim int, vectors array<float>, _tree int, _unit long, _role int, _place long"
    if not n_large:
        routed = kept.withColumns({"_tree": F.lit(0), "_unit": F.lit(0).cast("long"), "_role": F.lit(BOTH), "_place": F.lit(0).cast("long")})
    elif n_large <= MODELS:
        rows = _models(kept, large, coarse, seed).collect()
        models = spark.sparkContext.broadcast({tuple(r[:3]): _model(r.centre, r.norm, r.starts, r.parts) for r in rows})
        routed = kept.mapInArrow(lambda batches: _router(models.value, coarse, seed)(batches), schema)
    else:
        routed = kept.join(_models(kept, large, coarse, seed), GROUP, "left").mapInArrow(_router(None, coarse, seed), schema)
    found = (
        routed.repartition(2 * shuffle_width(spark), *KEY)
        .sortWithinPartitions(*KEY, "_place")
        .mapInArrow(_searcher(k, trees, target, seed), "vec_id long, near array<struct<d:double,id:long>>")
    )
    # Lists are read twice, by themselves and for the copies; the search runs once.
    near = cut(found)
    if n_large:
        near = near.groupBy("vec_id").agg(
            F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near")
        )
    more = members.join(classes, same).where(F.col("vec_id") > F.col("_last")).select(F.col("vec_id").alias("_copy"), "_first", "_own")
    # The smallest copy is as far from the others as these are from it; if none of them
    # is in its list, neither does it belong into theirs.
    twins = F.filter("near", lambda x: F.array_contains("_own", x["id"]))
    itself = F.array(F.struct(twins[0]["d"].alias("d"), F.col("_first").alias("id")))
    extended = F.when(F.size(twins) > 0, F.array_sort(F.concat(itself, "near"))).otherwise(F.col("near"))
    copies = more.join(near, more["_first"] == near["vec_id"]).select(
        F.col("_copy").alias("vec_id"), F.slice(extended, 1, k).alias("near")
    )
    return near.unionByName(copies)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """``vec_a`` < ``vec_b``: each pair once of which one is in the list of the other."""
    pairs = near.select("vec_id", F.explode("near.id").alias("_o"))
    return pairs.select(F.least("vec_id", "_o").alias("vec_a"), F.greatest("vec_id", "_o").alias("vec_b")).distinct()


def recall(df: DataFrame, k: int = 5, every: int = 100, cell: int = 1 << 15) -> DataFrame:
    """``index_id``, ``queries``, ``recall``: the share of exact neighbours that the forest
    lists for the usable vectors whose id is divisible by ``every``.

    The exact lists come from these queries against all rows of their index: rows and
    queries are cut into blocks, each pair of blocks is a task that keeps its k best for
    each query, and the best of these are the list."""
    points = usable(df)
    asks = points.where(F.col("vec_id") % every == 0)
    sizes = points.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("vec_id") % every == 0).alias("_q")).where("_q > 0")
    parts = sizes.select(*GROUP, F.ceil(F.col("_n") / cell).alias("_rows"), F.ceil(F.col("_q") / 1024).alias("_asks"))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = points.join(parts, GROUP).select("vec_id", *GROUP, "vectors", block("_rows").alias("_r"), every_of("_asks").alias("_a"))
    wanted = asks.join(parts, GROUP).select("vec_id", *GROUP, "vectors", block("_asks").alias("_a"), every_of("_rows").alias("_r"))
    wanted = wanted.toDF("ask", "i", "m", "n", "vector", "b", "r")

    def best(key, left, right):
        import pandas as pd

        metric = int(key[1])
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "d": [], "id": []})
        data, ask = left.sort_values("vec_id"), right.sort_values("ask")
        ids, x, q = data["vec_id"].to_numpy(), np.stack(data["vectors"].to_numpy()), np.stack(ask["vector"].to_numpy())
        out = []
        for i in range(len(q)):
            d = _exact(metric, q[i : i + 1], x[None])[0]
            d[ids == ask["ask"].iloc[i]] = np.inf
            top = np.argpartition(d, min(k, len(d) - 1))[: k + 1] if len(d) > k else np.arange(len(d))
            edge = np.sort(d[top])[min(k, len(top)) - 1]
            at = np.flatnonzero(d <= edge)
            at = at[np.lexsort((ids[at], d[at]))][:k]
            at = at[np.isfinite(d[at])]
            out.append(pd.DataFrame({"vec_id": np.full(len(at), ask["ask"].iloc[i]), "d": d[at], "id": ids[at]}))
        return pd.concat(out)

    cells = rows.groupBy(*GROUP, "_r", "_a").cogroup(wanted.groupBy("i", "m", "n", "r", "b"))
    found = cells.applyInPandas(best, "vec_id long, d double, id long")
    exact = found.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k)["id"].alias("exact"))
    listed = forest_neighbours(df, k).where(F.col("vec_id") % every == 0).select("vec_id", F.col("near.id").alias("listed"))
    both = asks.select("vec_id", "index_id").join(exact, "vec_id", "left").join(listed, "vec_id", "left")
    none = F.array().cast("array<bigint>")
    return both.groupBy("index_id").agg(
        F.count(F.lit(1)).alias("queries"),
        (
            F.sum(F.size(F.array_intersect(F.coalesce("exact", none), F.coalesce("listed", none))))
            / F.greatest(F.sum(F.size(F.coalesce("exact", none))), F.lit(1))
        ).alias("recall"),
    )
