"""Out-of-fold scores, bootstraps, tree models and their attributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sensitivity import Variant, refits


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Class-balanced ridge logistic regression by Newton steps."""
    w = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(a.shape[1]) / c
    ridge[-1, -1] = 0
    b = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        g = a.T @ (w * (p - y)) + ridge @ b
        h = (a * (w * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b - step
        if np.abs(step).max() < 1e-10:
            break
    return b[:-1], float(b[-1])


def out_of_fold(rows: DataFrame, columns: list[str], key: str, label: str = "y", fold: str = "fold", c: float = 1.0) -> DataFrame:
    """(key, fold, logit): each fold scored by a model of the others; columns standardised on the fitted rows.

    Models are fitted in passes of partial gradients, so no fold is gathered in one task. Rows without a label or
    with a null column are left out.
    """
    made, _ = refits(rows.filter(F.col(label).isNotNull()), columns, label, fold, key, [Variant("all")], c)
    return made.select(F.col("key").alias(key), "fold", "logit")


#: Clusters of a batch are drawn in slices of so many, so that a task holds slice x draws numbers.
CLUSTERS = 1024


def poisson_counts(cluster: np.ndarray, draws: int, seed: int, first: int = 1) -> np.ndarray:
    """(clusters, draws): Poisson numbers of mean 1 from the bits of cluster hash, draw (from `first` on) and seed; at most 8."""
    with np.errstate(over="ignore"):
        z = cluster.astype(np.uint64)[:, None] + (np.arange(first, first + draws, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    upto = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(8)])
    return np.searchsorted(upto, (z >> np.uint64(11)) / 2.0**53, side="right").astype(np.float64)


def poisson_sums(rows: DataFrame, cluster: str, values: list[str], draws: int = 200, seed: int = 0) -> DataFrame:
    """(draw, <v>, n_<v>): sum and number of each value under draws of whole clusters with replacement.

    A cluster's count in a draw depends on nothing but the two and the seed, so rows are summed where they are and a
    task hands on one row for each draw. Nulls and NaN of a value are not in its sum or number. Rows without a cluster are
    one cluster.
    """
    names = [f(v) for v in values for f in (str, "n_{}".format)]

    def run(batches):
        total = np.zeros((draws, len(names)))
        for b in batches:
            kinds, at = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(values))])
            have = ~np.isnan(x)
            both = [np.bincount(at, w, len(kinds)) for v, h in zip(np.where(have, x, 0.0), have.astype(float)) for w in (v, h)]
            sums = np.stack(both, axis=1)
            for s in range(0, len(kinds), CLUSTERS):
                total += poisson_counts(kinds[s : s + CLUSTERS], draws, seed).T @ sums[s : s + CLUSTERS]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, draws + 1, dtype=np.int32)), *[pa.array(c) for c in total.T]], names=["draw", *names])

    slim = rows.select(F.xxhash64(F.col(cluster).cast("string")).alias("c"), *[F.col(v).cast("double").alias(v) for v in values])
    parts = slim.mapInArrow(run, "draw int, " + ", ".join(f"`{n}` double" for n in names))
    return parts.groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])


def poisson_bootstrap(rows: DataFrame, cluster: str, values: list[str], draws: int = 200, seed: int = 0) -> DataFrame:
    """(draw, <v>): mean of each value under draws of whole clusters; null where a draw has none."""
    return poisson_sums(rows, cluster, values, draws, seed).select("draw", *[(F.col(v) / F.expr(f"nullif(`n_{v}`, 0)")).alias(v) for v in values])


def tree_scores(rows: DataFrame, columns: list[str], trees: list[dict], key: str) -> DataFrame:
    """(key, raw): sum of leaf values over flat trees {feature, threshold, left, right, value, missing_left}.

    A node below 0 in left is a leaf. Missing values (null or NaN) go the node's default way.
    """

    def run(batches):
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float)
            raw = np.zeros(len(x))
            for t in trees:
                feat, thr, left, right, val, default = (np.asarray(t[n]) for n in ("feature", "threshold", "left", "right", "value", "missing_left"))
                at = np.zeros(len(x), int)
                while (open_ := left[at] >= 0).any():
                    i = np.flatnonzero(open_)
                    v = x[i, feat[at[i]]]
                    go = np.where(np.isnan(v), default[at[i]], v <= thr[at[i]])
                    at[i] = np.where(go, left[at[i]], right[at[i]])
                raw += val[at]
            yield pd.DataFrame({key: pdf[key], "raw": raw})

    return rows.select(key, *columns).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, raw double")


def tree_attribution(rows: DataFrame, columns: list[str], trees: list[dict], key: str) -> DataFrame:
    """(key, bias, parts map): at each split the change of node value goes to the split's column.

    Bias is the sum of root values; bias and parts add up to the raw score. Missing values go the node's default way.
    """

    def run(batches):
        flat = [tuple(np.asarray(t[n]) for n in ("feature", "threshold", "left", "right", "value", "missing_left")) for t in trees]
        bias = float(sum(t[4][0] for t in flat))
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float)
            parts = np.zeros(x.shape)
            for feat, thr, left, right, val, default in flat:
                at = np.zeros(len(x), int)
                while len(i := np.flatnonzero(left[at] >= 0)):
                    node = at[i]
                    v = x[i, feat[node]]
                    at[i] = np.where(np.where(np.isnan(v), default[node], v <= thr[node]), left[node], right[node])
                    parts[i, feat[node]] += val[at[i]] - val[node]
            yield pd.DataFrame({key: pdf[key], "bias": bias, "parts": [dict(zip(columns, p)) for p in parts.tolist()]})

    return rows.select(key, *columns).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, bias double, parts map<string,double>")
