"""Rank correlations of many draws of the rows, every draw ranked anew.

A draw gives each row a count. The rank of a value in a draw is the sum of counts below it plus half of its own and a
half, so that a draw needs running sums over the distinct values, and all draws together need running sums of arrays.
Rows are reduced to distinct values where they are, dealt to value ranges, and summed along the sorted values of a
range; the sums of whole ranges are a small table. Draws are taken in slices that keep the arrays short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.functions.prefix import cuts_of
from plumbline.operators.folds import poisson_counts

#: Arrays of a slice of draws take so many bytes over all rows at most, but a slice has LEAST draws at least.
SLICE_BYTES, LEAST = 1 << 31, 16


def _binaries(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    edges = np.arange(len(rows) + 1, dtype=np.int32) * (rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(rows)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _by_value(draws: int, seed: int, first: int):
    """(part, v, c) to a row for each value of a batch: the counts of its rows in each draw."""

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 1 << 12):
                rows = b.slice(low, 1 << 12)
                v, back = np.unique(rows.column(1).to_numpy(), return_inverse=True)
                counts = poisson_counts(rows.column(2).to_numpy().view(np.uint64), draws, seed, first)
                total = np.zeros((len(v), draws))
                np.add.at(total, back, counts)
                part = np.zeros(len(v), np.int32)
                part[back] = rows.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(v), _binaries(total)], names=["part", "v", "w"])

    return run


def _along(draws: int):
    """Rows sorted by part and v to one row for each value: its counts, and the sum of counts before it in its part."""

    def run(batches):
        part = value = own = None
        before = np.zeros(draws)
        for b in batches:
            parts, values, w = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), draws)
            out = []
            for i in range(len(values)):
                if parts[i] == part and values[i] == value:
                    own = own + w[i]
                    continue
                if value is not None:
                    out.append((part, value, own, before))
                    before = before + own if parts[i] == part else np.zeros(draws)
                part, value, own = parts[i], values[i], w[i]
            yield from _values(out, draws)
        if value is not None:
            yield from _values([(part, value, own, before)], draws)

    return run


def _values(out: list, draws: int):
    if out:
        stacked = [_binaries(np.array([x[k] for x in out]).reshape(len(out), draws)) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.float64()), *stacked], names=["part", "v", "w", "before"])


def _ranked(rows: DataFrame, value: str, name: str, draws: int, seed: int, first: int) -> DataFrame:
    """(value, name): each distinct value with its rank in every draw, as a binary of doubles."""
    cuts = cuts_of(rows, [value])[0]
    part = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    counted = rows.select(part.cast("int").alias("part"), F.col(value).alias("v"), "c").mapInArrow(_by_value(draws, seed, first), "part int, v double, w binary")
    sorted_ = counted.repartition("part").sortWithinPartitions("part", "v")
    summed = settled(sorted_.mapInArrow(_along(draws), "part int, v double, w binary, before binary"))
    ends = summed.groupBy("part").agg(F.max_by(F.struct("w", "before"), "v").alias("e")).select("part", "e.w", "e.before").collect()  # a row for each range
    heads, total = {}, np.zeros(draws)
    for r in sorted(ends, key=lambda r: r["part"]):
        heads[r["part"]] = total
        total = total + np.frombuffer(r["w"]) + np.frombuffer(r["before"])

    def rank(batches):
        for b in batches:
            head = np.array([heads[p] for p in b.column(0).to_pylist()]).reshape(b.num_rows, draws)
            yield pa.RecordBatch.from_arrays([b.column(1), _binaries(head + _matrix(b.column(3), draws) + (_matrix(b.column(2), draws) + 1) / 2)], names=[value, name])

    return summed.mapInArrow(rank, f"`{value}` double, `{name}` binary")


def _sums(draws: int, seed: int, first: int):
    """(c, ra, rb) to a row for each draw: number, sums and products of the two ranks over its rows."""

    def run(batches):
        total = np.zeros((draws, 6))
        for b in batches:
            for low in range(0, b.num_rows, 1 << 12):
                rows = b.slice(low, 1 << 12)
                w = poisson_counts(rows.column(0).to_numpy().view(np.uint64), draws, seed, first)
                x, y = _matrix(rows.column(1), draws), _matrix(rows.column(2), draws)
                total += np.stack([(w * t).sum(axis=0) for t in (np.ones_like(w), x, y, x * x, y * y, x * y)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + draws, dtype=np.int32)), *[pa.array(t) for t in total.T]], names=["draw", "n", "x", "y", "xx", "yy", "xy"])

    return run


def _by_score(draws: int, seed: int, first: int):
    """(part, v, c, y) to a row for each score of a batch: the counts of its positive and its negative rows in each draw."""

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 1 << 12):
                rows = b.slice(low, 1 << 12)
                v, back = np.unique(rows.column(1).to_numpy(), return_inverse=True)
                counts = poisson_counts(rows.column(2).to_numpy().view(np.uint64), draws, seed, first)
                y = rows.column(3).to_numpy()
                total = np.zeros((len(v), 2, draws))
                np.add.at(total, (back, np.where(y == 1, 0, 1)), counts)
                part = np.zeros(len(v), np.int32)
                part[back] = rows.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(v), _binaries(total.reshape(len(v), -1))], names=["part", "v", "w"])

    return run


def min_dcf_draws(rows: DataFrame, cluster: str, score: str, draws: int, costs: dict[str, tuple[float, float, float]], seed: int = 0) -> DataFrame:
    """(draw, <name>): least cost of a score over all thresholds in each draw of whole clusters, for each named cost.

    A cluster's count in a draw is a Poisson number from its hash. Along the sorted distinct scores the counts of all
    draws are summed at once, as arrays; a draw with one class has null costs. Rows need y, 0 or 1, and a finite
    score; others are left out. The constant decisions count as thresholds.
    """
    slim = rows.filter(F.col("y").isin(0, 1)).select(F.xxhash64(F.col(cluster).cast("string")).alias("c"), F.col("y").cast("int").alias("y"), (F.col(score).cast("double") + 0.0).alias("v"))
    slim = settled(slim.filter("v is not null and not isnan(v) and abs(v) < double('inf')"))
    n, names = slim.count(), list(costs)
    schema = "draw int, " + ", ".join(f"`{c}` double" for c in names)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    cuts = cuts_of(slim, ["v"])[0]
    part = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("v"))) if cuts else F.lit(0)
    size = min(draws, max(LEAST, SLICE_BYTES // (32 * n)))
    made = None
    for first in range(1, draws + 1, size):
        some = min(size, draws + 1 - first)
        counted = slim.select(part.cast("int").alias("part"), "v", "c", "y").mapInArrow(_by_score(some, seed, first), "part int, v double, w binary")
        sorted_ = counted.repartition("part").sortWithinPartitions("part", "v")
        summed = settled(sorted_.mapInArrow(_along(2 * some), "part int, v double, w binary, before binary"))
        ends = summed.groupBy("part").agg(F.max_by(F.struct("w", "before"), "v").alias("e")).select("part", "e.w", "e.before").collect()  # a row for each range
        heads, total = {}, np.zeros(2 * some)
        for r in sorted(ends, key=lambda r: r["part"]):
            heads[r["part"]] = total
            total = total + np.frombuffer(r["w"]) + np.frombuffer(r["before"])

        def cheapest(batches, heads=heads, total=total.reshape(2, -1), some=some, first=first):
            least = np.full((len(names), some), np.inf)
            with np.errstate(divide="ignore", invalid="ignore"):
                for b in batches:
                    head = np.array([heads[p] for p in b.column(0).to_pylist()]).reshape(b.num_rows, 2 * some)
                    below = (head + _matrix(b.column(3), 2 * some)).reshape(-1, 2, some)
                    miss, alarm = below[:, 0] / total[0], (total[1] - below[:, 1]) / total[1]
                    for k, (c_fa, c_miss, prior) in enumerate(costs.values()):
                        cost = (c_fa * (1 - prior) * alarm + c_miss * prior * miss) / min(c_fa * (1 - prior), c_miss * prior)
                        least[k] = np.minimum(least[k], np.minimum(cost, 1.0).min(axis=0, initial=np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + some, dtype=np.int32)), *[pa.array(x) for x in least]], names=["draw", *names])

        least = summed.mapInArrow(cheapest, schema).groupBy("draw").agg(*[F.min(c).alias(c) for c in names])
        least = settled(least.select("draw", *[F.when(~F.isnan(c) & (F.col(c) < float("inf")), F.col(c)).alias(c) for c in names]))  # a row for each draw
        made = least if made is None else made.unionByName(least)
    return made


def spearman_draws(rows: DataFrame, key: str, a: str, b: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, n, rho): rank correlation of two columns in each draw of the rows with replacement, ranked within the draw.

    A row's count in a draw is a Poisson number from a hash of its key. Ties have their mean rank. Rows with a null or
    NaN in a column are left out; a draw where a column has one value only has a null rho. No rows give no draws.
    """
    slim = rows.select(F.xxhash64(F.col(key).cast("string")).alias("c"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    slim = settled(slim.filter("a is not null and b is not null and not isnan(a) and not isnan(b)").withColumns({"a": F.col("a") + 0.0, "b": F.col("b") + 0.0}))
    n = slim.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "draw int, n double, rho double")
    size = min(draws, max(LEAST, SLICE_BYTES // (16 * n)))
    parts = []
    for first in range(1, draws + 1, size):
        some = min(size, draws + 1 - first)
        ra, rb = (_ranked(slim, c, f"r{c}", some, seed, first) for c in "ab")
        both = slim.join(ra, "a").join(rb, "b").select("c", "ra", "rb")
        schema = "draw int, n double, x double, y double, xx double, yy double, xy double"
        sums = both.mapInArrow(_sums(some, seed, first), schema).groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
        parts.append(settled(sums))  # a row for each draw
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    spread = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / F.col("n")
    both = spread("x", "x", "xx") * spread("y", "y", "yy")
    return made.select("draw", "n", F.when((F.col("n") > 0) & (both > 1e-9), spread("x", "y", "xy") / F.sqrt(both)).alias("rho"))
