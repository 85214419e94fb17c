"""Fitted maps and distances: Platt's map, Mahalanobis novelty, seeded batches under quotas, drift inside a recording."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.functions.prefix import quantiles, running
from plumbline.functions.scalars import finite, jitter, sigmoid
from plumbline.operators.metrics import counted


def platt_fit(scores: DataFrame, c: float = 1e6, steps: int = 50) -> DataFrame:
    """One row (a, b, n, status): class-balanced logistic map of `score` to `y`, by Newton steps over distinct scores.

    Rows without a label or a score are left out. With one class or none, a and b are null.
    """
    at = settled(counted(scores, []))
    n_pos, n_neg = (int(v or 0) for v in at.agg(F.sum("pos"), F.sum("neg")).first())
    a, b, status = 0.0, 0.0, "ok"
    if not n_pos or not n_neg:
        a, b, status = None, None, "one class" if n_pos or n_neg else "empty"
    else:
        w1, w0 = ((n_pos + n_neg) / (2 * n) for n in (n_pos, n_neg))
        x = F.col("score")
        for _ in range(steps):
            p = sigmoid(a * x + b)
            g = w0 * F.col("neg") * p - w1 * F.col("pos") * (1 - p)
            h = (w1 * F.col("pos") + w0 * F.col("neg")) * p * (1 - p)
            ga, gb, haa, hab, hbb = at.agg(F.sum(g * x), F.sum(g), F.sum(h * x * x), F.sum(h * x), F.sum(h)).first()
            step = np.linalg.solve([[haa + 1 / c, hab], [hab, hbb + 1e-12]], [ga + a / c, gb])
            a, b = a - float(step[0]), b - float(step[1])
            if not math.isfinite(a + b) or max(abs(step)) < 1e-10:
                break
    return scores.sparkSession.createDataFrame([(a, b, n_pos + n_neg, status)], "a double, b double, n long, status string")


def stacker(rows: DataFrame, names: list[str], use: str, c: float = 1.0, steps: int = 25, shrink: float = 0.5) -> DataFrame:
    """(name, coefficient, weight): non-negative fusion weights from a joint class-balanced logistic fit on z-scores.

    Columns are standardised over all rows and fitted on labelled rows where `use` is true. Coefficients below zero
    are cut, the rest made to sum to one and drawn towards equal weights by `shrink`; all zero are equal. With one
    class there is no fit: coefficients are null and weights equal. Rows with a null or NaN in a column are left out.
    """
    k = len(names)
    clean = rows.filter(finite(*[F.col(n).cast("double") for n in names]))
    moments = clean.agg(*[f(F.col(n).cast("double")) for n in names for f in (F.avg, F.stddev_pop)]).first()
    z = [((F.col(n).cast("double") - moments[2 * i]) / moments[2 * i + 1] if moments[2 * i + 1] else F.lit(0.0)).alias(f"z{i}") for i, n in enumerate(names)]
    at = settled(clean.filter(F.col(use) & F.col("y").isin(0, 1)).select(F.col("y").cast("double").alias("y"), *z))
    n, pos = at.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    b = np.zeros(k + 1)
    fitted = 0 < pos < n
    if fitted:
        x = [*[F.col(f"z{i}") for i in range(k)], F.lit(1.0)]
        weight = F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        ridge = np.diag([1 / c] * k + [0.0])
        for _ in range(steps):
            p = sigmoid(sum((float(b[i]) * x[i] for i in range(k + 1)), F.lit(0.0)))
            step = at.select("*", (weight * (p - F.col("y"))).alias("g"), (weight * p * (1 - p)).alias("h"))
            got = step.agg(*[F.sum(F.col("g") * v) for v in x], *[F.sum(F.col("h") * x[i] * x[j]) for i, j in pairs]).first()
            h = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, got[k + 1 :]):
                h[i, j] = h[j, i] = v
            move = np.linalg.solve(h + ridge + np.diag([0.0] * k + [1e-12]), np.array(got[: k + 1]) + ridge @ b)
            b = b - move
            if np.abs(move).max() < 1e-10:
                break
    cut = np.maximum(b[:k], 0)
    share = cut / cut.sum() if cut.sum() > 0 else np.full(k, 1 / k)
    made = [(name, float(b[i]) if fitted else None, float((1 - shrink) * share[i] + shrink / k)) for i, name in enumerate(names)]
    return rows.sparkSession.createDataFrame(made, "name string, coefficient double, weight double")


def distances(rows: DataFrame, key: str, vector: str, fitted: str, ridge: float = 1e-3) -> DataFrame:
    """(key, fitted, distance): squared Mahalanobis distance from the rows where `fitted` is true.

    Columns are standardised and the covariance gets a ridge. Three passes; the driver holds width squared numbers.
    Vectors that are null, of another width than the widest or not finite have no distance.
    """
    d = rows.select(key, F.coalesce(F.col(fitted), F.lit(False)).alias("fitted"), F.col(vector).cast("array<double>").alias("x"))
    width = d.agg(F.max(F.size("x"))).first()[0] or 0
    whole = (F.size("x") == width) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    base = d.filter(F.col("fitted") & whole)
    columns = base.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not columns:
        return d.select(key, "fitted", F.lit(None).cast("double").alias("distance"))
    mean, sd = np.array([r["m"] for r in columns]), np.array([r["s"] for r in columns]) + 1e-9

    def products(batches):
        total, n = np.zeros((width, width)), 0
        for pdf in batches:
            z = (np.stack(pdf["x"]) - mean) / sd if len(pdf) else np.empty((0, width))
            total, n = total + z.T @ z, n + len(z)
        yield pd.DataFrame({"i": np.arange(width * width + 1), "v": np.append(total.ravel(), n)})

    got = base.select("x").mapInPandas(products, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r["v"] for r in got])
    inverse = np.linalg.inv(flat[:-1].reshape(width, width) / max(flat[-1] - 1, 1) + ridge * np.eye(width))

    def measure(batches):
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            at = np.flatnonzero(pdf["whole"].to_numpy(dtype=bool))
            if len(at):
                z = (np.stack(pdf["x"].iloc[at]) - mean) / sd
                out[at] = np.einsum("ij,jk,ik->i", z, inverse, z)
            yield pd.DataFrame({key: pdf[key], "fitted": pdf["fitted"], "distance": out})

    kind = rows.schema[key].dataType.simpleString()
    made = d.withColumn("whole", F.coalesce(whole, F.lit(False))).mapInPandas(measure, f"{key} {kind}, fitted boolean, distance double")
    return made.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def novelty_share(rows: DataFrame, key: str, vector: str, fitted: str, share: float = 0.99) -> DataFrame:
    """One row (border, n, novelty): share of the other rows that lie beyond the fitted rows' quantile of distance."""
    d = settled(distances(rows, key, vector, fitted))
    border = quantiles(d.filter("fitted"), "distance", {"border": share})
    rest = d.filter("not fitted and distance is not null")
    return rest.join(F.broadcast(border)).agg(F.max("border").alias("border"), F.count("*").alias("n"), F.avg((F.col("distance") > F.col("border")).cast("int")).alias("novelty"))  # one row


def quota_batches(rows: DataFrame, key: str, label: str, source: str, mix: dict[str, float], steps: int, batch: int, seed: int = 7) -> DataFrame:
    """(step, place, label, source, key): seeded batches, half of each label, sources drawn by their weight, rows with replacement.

    Weights are of the sources that a label has; where it has none of those named, all its sources weigh the same. Keys
    must be distinct; rows without key, label or source are not drawn. Rows are numbered over ranges of keys, so a hot
    source is not one task; the places of a batch are joined to them by number.
    """
    ok = rows.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & F.col(source).isNotNull()).select(F.col(label).cast("int").alias("label"), F.col(source).alias("source"), F.col(key).alias("key"))
    ok = settled(ok.withColumn("one", F.lit(1)))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in mix.items() for v in kv]), F.col("source")), F.lit(0.0)) if mix else F.lit(0.0)
    pools = ok.groupBy("label", "source").agg(F.count("*").alias("n")).withColumn("w", weight)
    total = pools.groupBy("label").agg(F.sum("w").alias("named"), F.count("*").alias("kinds"))
    p = F.when(F.col("named") > 0, F.col("w") / F.col("named")).otherwise(1.0 / F.col("kinds"))
    pools = pools.join(total, "label").withColumn("p", p).filter("p > 0")
    upto = F.sum("p").over(Window.partitionBy("label").orderBy("source"))
    last = F.lead("source").over(Window.partitionBy("label").orderBy("source")).isNull()
    pools = pools.select("label", "source", "n", (upto - F.col("p")).alias("low"), F.when(last, 2.0).otherwise(upto).alias("high"))
    slot = rows.sparkSession.range(steps * batch).select(F.floor(F.col("id") / batch).cast("int").alias("step"), (F.col("id") % batch).cast("int").alias("place"))
    draw = lambda what: jitter(F.concat_ws(":", F.lit(f"{what}:{seed}"), "step", "place"))
    slot = slot.withColumn("label", (F.col("place") >= batch // 2).cast("int")).withColumn("u", draw("src")).withColumn("v", draw("row"))
    drawn = slot.join(pools, "label").filter("u >= low and u < high").withColumn("number", F.floor(F.col("v") * F.col("n")) + 1)
    numbered = running(ok, ["label", "source"], "key", ["one"]).withColumnRenamed("run_one", "number")
    return drawn.join(numbered, ["label", "source", "number"]).select("step", "place", "label", "source", "key")


#: Least cosine of two windows of one recording below which the speaker has changed. Fixed value.
DRIFT = 0.05


def drift(windows: DataFrame, clip: str, place: str, vector: str) -> DataFrame:
    """(clip, n_windows, cos_min, cos_mean, cos_std, cos_adjacent_min, drift) over all pairs of a clip's windows.

    A clip has at most 15 s and so at most 29 windows; pairs are taken inside the clip's row. One window: cosines 1, no spread.
    """
    x = F.col(vector).cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)) + 1e-9
    units = windows.select(clip, place, F.transform(x, lambda v: v / size).alias("e")).filter("e is not null")
    clips = units.groupBy(clip).agg(F.array_sort(F.collect_list(F.struct(place, "e"))).alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    later = lambda a, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda b: dot(a["e"], b["e"]))
    rows = clips.withColumn("c", F.transform("w", later))
    rows = rows.withColumn("pairs", F.flatten("c")).withColumn("next", F.transform(F.filter("c", lambda a: F.size(a) > 0), lambda a: a[0]))
    n = F.size("pairs")
    total = lambda f: F.aggregate(F.transform("pairs", f), F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("mean", total(lambda v: v) / F.expr("nullif(size(pairs), 0)"))
    spread = F.sqrt(total(lambda v: (v - F.col("mean")) * (v - F.col("mean"))) / F.expr("nullif(size(pairs), 0)"))
    alone = lambda v, other, name: F.when(n > 0, v).otherwise(other).alias(name)
    return rows.select(
        clip, F.size("w").alias("n_windows"), alone(F.array_min("pairs"), 1.0, "cos_min"), alone(F.col("mean"), 1.0, "cos_mean"), alone(spread, 0.0, "cos_std"),
        alone(F.array_min("next"), 1.0, "cos_adjacent_min"), alone((F.array_min("pairs") < DRIFT).cast("double"), 0.0, "drift"),
    )
