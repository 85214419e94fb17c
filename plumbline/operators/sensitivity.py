"""Refits without a column, a family of columns or a part of the rows, all of them in the same passes over the data."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.operators import metrics as me


def grams(rows: DataFrame, columns: list[str], label: str, by: str) -> dict[str, np.ndarray]:
    """Of each value of `by`: sums of products of (1, columns, label) with themselves. One pass; rows with a null are left out."""
    d = len(columns) + 2

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            part = np.array(b.column(0).to_pylist(), object)
            a = np.column_stack([np.ones(b.num_rows), *[b.column(i).to_numpy() for i in range(1, b.num_columns)]])
            for key in set(part.tolist()):
                at = a[part == key]
                total[key] = total.get(key, 0) + at.T @ at
        keys = sorted(total)
        cell = np.tile(np.arange(d * d, dtype=np.int32), len(keys))
        flat = np.concatenate([total[k].ravel() for k in keys]) if keys else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, d * d).tolist(), pa.string()), pa.array(cell), pa.array(flat)], names=["part", "cell", "v"])

    names = [*columns, label]
    ok = rows.select(F.col(by).cast("string").alias("part"), *[F.col(c).cast("double").alias(c) for c in names]).dropna()
    got = ok.mapInArrow(run, "part string, cell int, v double").groupBy("part", "cell").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for part, cell, v in got:
        out.setdefault(part, np.zeros(d * d))[cell] = v
    return {k: v.reshape(d, d) for k, v in sorted(out.items())}


def least_squares_study(rows: DataFrame, columns: list[str], label: str, fold: str, drops: dict[str, list[str]], ridge: float = 0.0, fit_only: str | None = None) -> DataFrame:
    """(variant, n, mse): out-of-fold error of least squares fits, each without the named columns.

    Fits and errors of all variants and folds are solved from one table of sums by fold; the rows are read once. Rows
    for which `fit_only` holds are fitted with their fold and not read out.
    """
    twin = F.coalesce(F.col(fit_only), F.lit(False)) if fit_only else F.lit(False)
    parts = grams(rows.withColumn("_part", F.concat(F.when(twin, "+").otherwise("-"), F.col(fold).cast("string"))), columns, label, "_part")
    none = np.zeros((len(columns) + 2,) * 2)
    sums = {f: parts.get(f"-{f}", none) for f in sorted({k[1:] for k in parts})}
    fitted = {f: own + parts.get(f"+{f}", none) for f, own in sums.items()}
    whole = sum(fitted.values(), none)
    out = []
    for name, gone in drops.items():
        at = [0, *[i + 1 for i, c in enumerate(columns) if c not in gone]]
        penalty = ridge * np.diag([0.0] + [1.0] * (len(at) - 1))
        error = n = 0.0
        for f, own in sums.items():
            rest = whole - fitted[f]
            if rest[0, 0] == 0:
                continue
            b = np.linalg.lstsq(rest[np.ix_(at, at)] + penalty, rest[at, -1], rcond=None)[0]
            error += own[-1, -1] - 2 * b @ own[at, -1] + b @ own[np.ix_(at, at)] @ b
            n += own[0, 0]
        out.append((name, int(n), float(error / n) if n else None))
    return rows.sparkSession.createDataFrame(out, "variant string, n long, mse double")


@dataclass(frozen=True)
class Variant:
    """A refit: without some columns, and without the rows for which a condition holds."""

    name: str
    drop: frozenset[str] = frozenset()
    without: Column | None = field(default=None, compare=False)


def _slim(rows: DataFrame, columns: list[str], label: str, fold: str, key: str, variants: list[Variant]) -> DataFrame:
    gone = [F.coalesce(v.without, F.lit(False)) if v.without is not None else F.lit(False) for v in variants]
    x = F.array(*[F.col(c).cast("double") for c in columns])
    ok = rows.dropna(subset=columns)
    return ok.select(F.col(key).alias("key"), F.col(fold).cast("string").alias("fold"), F.col(label).cast("double").alias("y"), x.alias("x"), F.array(*gone).alias("gone"))


def _arrays(b: pa.RecordBatch, d: int, v: int) -> tuple[np.ndarray, ...]:
    """fold, y (NaN for rows to be judged), x and gone of a batch."""
    n = b.num_rows
    x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, d)
    gone = b.column(4).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(n, v)
    y = b.column(2).to_numpy(zero_copy_only=False).astype(float)
    return np.array(b.column(1).to_pylist(), object), y, x, gone


def _fitted(slim: DataFrame, d: int, variants: list[Variant], keep: list[np.ndarray], c: float, steps: int) -> list[dict]:
    """A model of each variant for each fold (of the other folds' rows) and one (fold None) of all."""
    v = len(variants)

    def moments(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            fold, y, x, gone = _arrays(b, d, v)
            known = ~np.isnan(y)
            row = np.column_stack([np.ones(len(y)), np.nan_to_num(y), x, x * x])
            for f in set(fold[known].tolist()):
                for j in range(v):
                    use = known & (fold == f) & ~gone[:, j]
                    total[f, j] = total.get((f, j), 0) + row[use].sum(axis=0)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["fold", "variant", "sums"])

    got = slim.mapInArrow(moments, "fold string, variant int, sums array<double>").select("fold", "variant", F.posexplode("sums").alias("i", "s")).groupBy("fold", "variant", "i").agg(F.sum("s").alias("s")).collect()
    sums: dict[tuple, np.ndarray] = {}
    for r in got:
        sums.setdefault((r["fold"], r["variant"]), np.zeros(2 + 2 * d))[r["i"]] = r["s"]
    folds = sorted({f for f, _ in sums}, key=str)
    models = []
    for j in range(v):
        for f in [*folds, None]:
            s = sum((x for (g, i), x in sums.items() if i == j and (f is None or g != f)), np.zeros(2 + 2 * d))
            n, pos = max(s[0], 1), s[1]
            mean = s[2 : 2 + d] / n
            sd = np.sqrt(np.maximum(s[2 + d :] / n - mean**2, 1e-18))
            models.append({"variant": j, "fold": f, "at": keep[j], "mean": mean[keep[j]], "sd": sd[keep[j]], "w1": n / (2 * max(pos, 1)), "w0": n / (2 * max(n - pos, 1)), "b": np.zeros(len(keep[j]) + 1)})
    width = d + 1

    for _ in range(steps):
        def slopes(batches, models=models):
            total = np.zeros((len(models), width * (width + 1)))
            for b in batches:
                fold, y, x, gone = _arrays(b, d, v)
                for k, m in enumerate(models):
                    use = ~np.isnan(y) & ~gone[:, m["variant"]]
                    if m["fold"] is not None:
                        use &= fold != m["fold"]
                    a = np.hstack([(x[use][:, m["at"]] - m["mean"]) / m["sd"], np.ones((use.sum(), 1))])
                    p = 1 / (1 + np.exp(-np.clip(a @ m["b"], -35, 35)))
                    w = np.where(y[use] == 1, m["w1"], m["w0"])
                    e = len(m["b"])
                    total[k, :e] += a.T @ (w * (p - y[use]))
                    total[k, width : width + e * e] += ((a * (w * p * (1 - p))[:, None]).T @ a).ravel()
            k, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[k, i])], names=["model", "cell", "s"])

        flat = np.zeros((len(models), width * (width + 1)))
        for k, i, s in slim.mapInArrow(slopes, "model int, cell int, s double").groupBy("model", "cell").agg(F.sum("s").alias("s")).collect():
            flat[k, i] = s
        moved = 0.0
        for k, m in enumerate(models):
            e = len(m["b"])
            ridge = np.diag([1 / c] * (e - 1) + [0.0])
            step = np.linalg.solve(flat[k, width : width + e * e].reshape(e, e) + ridge + 1e-9 * np.eye(e), flat[k, :e] + ridge @ m["b"])
            m["b"] = m["b"] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    return models


def _judged(slim: DataFrame, d: int, v: int, models: list[dict], key_type: str) -> DataFrame:
    """(key, fold, variant, y, logit): labelled rows by the model of their fold, rows without a label by the model of all."""

    def run(batches):
        for b in batches:
            fold, y, x, gone = _arrays(b, d, v)
            logit = np.full((len(y), v), np.nan)
            for m in models:
                own = np.isnan(y) if m["fold"] is None else ~np.isnan(y) & (fold == m["fold"]) & ~gone[:, m["variant"]]
                logit[own, m["variant"]] = (x[own][:, m["at"]] - m["mean"]) / m["sd"] @ m["b"][:-1] + m["b"][-1]
            row, j = np.nonzero(~np.isnan(logit))
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(j.astype(np.int32)), b.column(2).take(own), pa.array(logit[row, j])], names=["key", "fold", "variant", "y", "logit"])

    return slim.mapInArrow(run, f"key {key_type}, fold string, variant int, y double, logit double")


def refits(rows: DataFrame, columns: list[str], label: str, fold: str, key: str, variants: list[Variant], c: float = 1.0, steps: int = 25) -> tuple[DataFrame, list[dict]]:
    """(key, fold, variant, y, logit) of every variant, out of fold for labelled rows, and the fitted models.

    Class-balanced ridge logistic models on standardised columns, as many as variants times folds and one of all rows;
    a Newton step of all of them is one pass. A labelled row that a variant leaves out has no logit there. Rows with a
    null column are left out. Numbers of variants, folds and columns are taken to be small.
    """
    keep = [np.array([i for i, name in enumerate(columns) if name not in v.drop], int) for v in variants]
    slim = settled(_slim(rows, columns, label, fold, key, variants))
    models = _fitted(slim, len(columns), variants, keep, c, steps)
    made = _judged(slim, len(columns), len(variants), models, rows.schema[key].dataType.simpleString())
    names = F.array(*[F.lit(v.name) for v in variants])
    return made.withColumn("variant", F.get(names, F.col("variant"))), models


def study(rows: DataFrame, columns: list[str], label: str, fold: str, key: str, variants: list[Variant], least_gap: float = 0.2) -> DataFrame:
    """(variant, dropped, n, auc, tpr, fpr, q, share, mean_p): what each refit says about the rows without a label.

    q is the share of them that it calls positive, tpr and fpr its rates out of fold; share corrects q by those rates
    and is null where they are less than `least_gap` apart. To the given variants, `all` and one without the column of
    the largest standardised coefficient are added.
    """
    base = [Variant("all"), *variants]
    first, models = refits(rows, columns, label, fold, key, base)
    whole = next(m for m in models if m["variant"] == 0 and m["fold"] is None)
    top = columns[int(np.abs(whole["b"][:-1]).argmax())]
    second, _ = refits(rows, columns, label, fold, key, [Variant("without top", frozenset({top}))])
    scored = settled(first.unionByName(second))
    hit = (F.col("logit") > 0).cast("double")
    known = F.col("y").isNotNull()
    sums = scored.groupBy("variant").agg(
        F.count_if(known).alias("n"), F.avg(F.when(F.col("y") == 1, hit)).alias("tpr"), F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"),
        F.avg(F.when(~known, hit)).alias("q"), F.avg(F.when(~known, 1 / (1 + F.exp(-F.col("logit"))))).alias("mean_p"),
    )
    auc = me.auc(scored.filter(known).select("variant", F.col("y").cast("int").alias("y"), F.col("logit").alias("score")), ["variant"]).select("variant", "auc")
    dropped = rows.sparkSession.createDataFrame([(v.name, ",".join(sorted(v.drop))) for v in base] + [("without top", top)], "variant string, dropped string")
    gap = F.col("tpr") - F.col("fpr")
    share = F.when(gap >= least_gap, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("q") - F.col("fpr")) / gap)))
    return sums.join(auc, "variant", "left").join(F.broadcast(dropped), "variant").select("variant", "dropped", "n", "auc", "tpr", "fpr", "q", share.alias("share"), "mean_p")  # a row for each variant
