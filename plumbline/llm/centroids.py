"""Centroid clustering of integer vectors with Drake's adaptive bounds.

A vector keeps an upper bound on the distance to its own centroid, lower bounds on the distances to the few
centroids that come next, and one lower bound for all the rest. When centroids move, bounds are loosened by as much
as they moved. As long as a bound is strictly above the upper bound, no centroid behind it can be nearer or as near,
so only those before it are compared; a vector whose remainder bound is not above is compared with all. Bounds
hold a small margin for rounding and decide only what is skipped: distances that are compared are exact integers.
After each round the number of bounds shrinks to what the vectors needed.

Vectors are packed as the smallest integers that hold them, next to their bounds, in one checkpoint for each round.
A task adds up its vectors by centroid; the driver sees one sum for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed

#: Components beyond this, as integers, could not give distances that fit in a long.
LARGEST = 1 << 27
#: Relative margin of bounds, far above the rounding of a few operations on doubles.
MARGIN = 1e-12
STATE = "id long, v binary, cluster int, near binary, bounds binary, sums binary"


def packed(v: np.ndarray) -> pa.Array:
    """Rows of integers as binaries of the smallest kind that holds all of them."""
    most = int(np.abs(v).max(initial=0))
    return binaries(v.astype(np.int8 if most < 128 else np.int16 if most < 1 << 15 else np.int32))


def binaries(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    edges = np.arange(len(rows) + 1, dtype=np.int32) * (rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(rows)])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of packed(), whatever kind each has."""
    rows = column.to_pylist()
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.empty((len(rows), width), np.int64)
    for kind in (np.int8, np.int16, np.int32):
        which = np.flatnonzero(size == width * np.dtype(kind).itemsize)
        if len(which):
            out[which] = np.frombuffer(b"".join([rows[i] for i in which]), kind).reshape(-1, width)
    return out


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all rows of c."""
    most = max(int(np.abs(x).max(initial=0)) for x in (v, c))
    if most * most * v.shape[1] < 1 << 51:  # products and their sums are exact in doubles
        f, g = v.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared) * (1 + MARGIN)


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared) * (1 - MARGIN)


class Bounds:
    """near: of each row its own centroid and the next ones. low: bounds of the next ones, the last one of all others. up: of its own."""

    def __init__(self, near: np.ndarray, up: np.ndarray, low: np.ndarray):
        self.near, self.up, self.low = near, up, low

    @staticmethod
    def scanned(v: np.ndarray, c: np.ndarray, keep: int) -> Bounds:
        """From all distances; ties go to the smaller number."""
        d = squares(v, c)
        order = np.argsort(d, axis=1, kind="stable")[:, : keep + 2]
        by = np.take_along_axis(d, order, axis=1)
        low = below(by[:, 1:])
        if low.shape[1] <= keep:  # no centroid is left for the remainder bound
            low = np.hstack((low, np.full((len(v), 1), np.inf)))
        return Bounds(order[:, : keep + 1], above(by[:, 0]), low)

    def moved(self, v: np.ndarray, c: np.ndarray, by: np.ndarray) -> int:
        """Assign anew after centroids moved by at most `by`; the most bounds that a row without a whole scan needed."""
        own = self.near[:, 0]
        self.up = (self.up + by[own]) * (1 + MARGIN)
        self.low[:, :-1] -= by[self.near[:, 1:]]
        self.low[:, -1] -= by.max(initial=0)
        self.low *= np.where(self.low > 0, 1 - MARGIN, 1 + MARGIN)
        floor = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self.up >= floor[:, 0])
        self.up[open_] = above(((v[open_] - c[own[open_]]) ** 2).sum(axis=1))
        keep = self.low.shape[1] - 1
        need = (self.up[open_, None] >= floor[open_]).sum(axis=1)  # floors rise: so many bounds are not above
        used = 0
        for n in np.unique(need[(need > 0) & (need <= keep)]).tolist():
            i = open_[need == n]
            used = max(used, n)
            some = np.sort(self.near[i, : n + 1], axis=1)  # by number, so that a stable order settles ties
            d = ((v[i, None, :] - c[some]) ** 2).sum(axis=2)
            order = np.argsort(d, axis=1, kind="stable")
            by_d = np.take_along_axis(d, order, axis=1)
            self.near[i, : n + 1] = np.take_along_axis(some, order, axis=1)
            self.up[i], self.low[i, :n] = above(by_d[:, 0]), below(by_d[:, 1:])
        whole = open_[need > keep]
        if len(whole):
            new = Bounds.scanned(v[whole], c, keep)
            self.near[whole], self.up[whole], self.low[whole] = new.near, new.up, new.low
        return used

    def cut(self, keep: int) -> None:
        """Fewer bounds: those that go are merged into the remainder bound."""
        if keep < self.low.shape[1] - 1:
            self.low = np.hstack((self.low[:, :keep], self.low[:, keep:].min(axis=1, keepdims=True)))
            self.near = self.near[:, : keep + 1]


def _state(ids: pa.Array, v: np.ndarray, b: Bounds) -> pa.RecordBatch:
    columns = [ids, packed(v), pa.array(b.near[:, 0].astype(np.int32)), binaries(b.near.astype(np.int32)), binaries(np.hstack((b.up[:, None], b.low)))]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(v), pa.binary())], names=["id", "v", "cluster", "near", "bounds", "sums"])


def _add(total: dict[int, np.ndarray], v: np.ndarray, own: np.ndarray) -> None:
    """Count and sum of the rows of each centroid."""
    for k in np.unique(own).tolist():
        rows = v[own == k]
        total[k] = total.get(k, 0) + np.concatenate(([len(rows)], rows.sum(axis=0)))


def _total(total: dict[int, np.ndarray], used: int) -> pa.RecordBatch:
    """A row for each centroid that the task met, with `used` in front of its sums."""
    n = len(total)
    sums = binaries(np.array([[used, *x] for x in total.values()], np.int64)) if n else pa.array([], pa.binary())
    columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(list(total), pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), sums]
    return pa.RecordBatch.from_arrays(columns, names=["id", "v", "cluster", "near", "bounds", "sums"])


def _first(c: np.ndarray, keep: int):
    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            v = integers(batch.column(1), c.shape[1])
            b = Bounds.scanned(v, c, keep)
            _add(total, v, b.near[:, 0])
            yield _state(batch.column(0), v, b)
        yield _total(total, 0)

    return run


def _loaded(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, Bounds]:
    v = unpacked(batch.column(1), width)
    near = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32).reshape(len(v), -1).astype(np.int64)
    bounds = np.frombuffer(b"".join(batch.column(4).to_pylist())).reshape(len(v), -1)
    return v, Bounds(near, bounds[:, 0].copy(), bounds[:, 1:].copy())


def _next(c: np.ndarray, by: np.ndarray, keep: int):
    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        used = 0
        for batch in (b for b in batches if b.num_rows):
            v, b = _loaded(batch, c.shape[1])
            b.cut(keep)
            used = max(used, b.moved(v, c, by))
            _add(total, v, b.near[:, 0])
            yield _state(batch.column(0), v, b)
        yield _total(total, used)

    return run


def _last(c: np.ndarray, by: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in (b for b in batches if b.num_rows):
            v, b = _loaded(batch, c.shape[1])
            b.moved(v, c, by)
            own = b.near[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(((v - c[own]) ** 2).sum(axis=1))], names=["id", "cluster", "distance"])

    return run


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(64 * x) of lists of doubles."""
    v = np.floor(64 * column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
    if np.abs(v).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // 64}: squared distances would not fit in a long")
    return v.astype(np.int64)


def _moves(state: DataFrame, c: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids after a round, and the most bounds that a row needed; sums are added up by Spark in longs."""
    rows = state.filter("sums is not null").select("cluster", "sums")

    def cells(batches):
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), pa.int32()), pa.array(range(len(x)), pa.int32()), pa.array(x)], names=["cluster", "cell", "x"])

    summed = rows.mapInArrow(cells, "cluster int, cell int, x long").groupBy("cluster", "cell").agg(F.sum("x").alias("x"), F.max("x").alias("most"))
    total = np.zeros((len(c), c.shape[1] + 1), np.int64)
    used = 0
    for k, cell, x, most in summed.collect():  # a row for each centroid and component
        if cell:
            total[k, cell - 1] = x
        else:
            used = max(used, most)
    n = total[:, :1]
    return np.where(n > 0, total[:, 1:] // np.maximum(n, 1), c), used


def clustered(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, keep: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) for each vector of `width` finite components, and the final centroids.

    Vectors that are null, of another width, or hold a null or a non-finite component are left out. Equal rows are
    vectors each and get equal results; a null id stays null and is hashed as the empty text. Fewer than k vectors
    give as many centroids; none give no rows. A component x counts as floor(64 * x); one beyond 2,097,152 is an
    error. `keep`: lower bounds that a vector has at first (None: a quarter of k); they never fall below an eighth.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter((F.size("v") == width) & finite)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    whole = F.transform("v", lambda x: F.floor(x * 64))
    start = [r["v"] for r in kept.select(key.alias("key"), whole.alias("v")).orderBy("key", "v").limit(k).collect()]
    c = np.array(start, dtype=np.int64).reshape(len(start), width)
    out = "id long, cluster int, distance long"
    if not len(c):
        return vectors.sparkSession.createDataFrame([], out), c
    keep, least = -(-k // 4) if keep is None else keep, max(1, k // 8)
    state = checkpointed(kept.mapInArrow(_first(c, keep), STATE))
    for turn in range(rounds):
        new, used = _moves(state, c)
        by = above(((new - c) ** 2).sum(axis=1))
        c, rows = new, state.filter("sums is null")
        if turn == rounds - 1:
            return rows.mapInArrow(_last(c, by), out), c
        keep = max(least, min(keep, used)) if turn else keep
        state = checkpointed(rows.mapInArrow(_next(c, by, keep), STATE))
    raise ValueError("one round at least")


def op12(vectors: DataFrame) -> DataFrame:
    """Contract columns of the clustering query."""
    found, c = clustered(vectors.select("vec_id", "embedding"))
    found = checkpointed(found)
    sha = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    sums = checkpointed(found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")))
    inertia = sums.agg(F.sum("cluster_inertia").cast("long")).first()[0]
    named = F.get(F.array(*[F.lit(x) for x in sha]) if sha else F.array(F.lit("")), F.col("cluster"))
    rows = found.join(F.broadcast(sums), "cluster")  # a row for each centroid
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), named.alias("centroid_sha256"))
