"""Rank fusion of detector scores, one-way suppression, and the decision policy."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.functions.prefix import running
from plumbline.functions.scalars import BLOCK, FAILED, JITTER, determinate, jitter, platt, sigmoid

DETECTORS = ("s1", "s2", "s3")
#: Shipped weights, suppression rule and Platt map. Fixed values.
WEIGHTS = {"s1": 0.6, "s2": 0.2, "s3": 0.2}
E_THRESHOLD, E_FLOOR, E_FACTOR = -3.0, 0.5, 0.5
PLATT_A, PLATT_B, PRIOR_SHIFT = 17.6928266, -8.1514753, math.log(0.3 / 0.7)


#: Tables of ranks of at most so many rows are broadcast; beyond, those of values that more than one row in FEW has.
RANKS, FEW = 200_000, 5_000


def _looked_up(rows: DataFrame, rank: DataFrame, col: str, name: str, asked: int, small: bool) -> DataFrame:
    """`rows` plus the rank of their value, from (v, times, rank); missing values have 0.5."""

    def joined(d: DataFrame, k: DataFrame) -> DataFrame:
        on = F.col(f"r.`{col}`") == F.col("k.v")
        return d.alias("r").join(k.alias("k"), on, "left").select("r.*", F.coalesce("k.rank", F.lit(0.5)).alias(name))

    if small:
        return joined(rows, F.broadcast(rank))
    often = rank.filter(F.col("times") * FEW > asked)
    marked = joined(rows, F.broadcast(often.select("v", F.lit(1.0).alias("rank")))).withColumnRenamed(name, "_often")
    hot = joined(marked.filter("_often = 1").drop("_often"), F.broadcast(often))
    return hot.unionByName(joined(marked.filter("_often < 1").drop("_often"), rank))


def ranked(rows: DataFrame, reference: DataFrame, detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """`rows` plus r_<d> for each detector: the share of reference values strictly below the row's; missing values have 0.5.

    The values of all detectors are counted in one table, and one running sum over distinct values gives their ranks,
    so that no value meets another. Each side is read once for the counts.
    """

    def values(d: DataFrame, n: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("d"), F.col(c).cast("double").alias("v")) for c in detectors])
        return d.select(F.explode(pairs).alias("p")).select("p.d", "p.v", F.lit(n).alias("n"), F.lit(1 - n).alias("times")).filter("v is not null and not isnan(v)")

    both = values(reference, 1).unionByName(values(rows, 0)).groupBy("d", "v").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    counts = settled(both)
    sums = {r["d"]: r for r in counts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("times").alias("times"), F.count("*").alias("kinds")).collect()}  # a row for each detector
    size = F.create_map(*[x for d, r in sums.items() for x in (F.lit(d), F.lit(float(r["n"])))]) if sums else F.create_map(F.lit(""), F.lit(0.0))
    below = (F.col("run_n") - F.col("n")) / F.expr("nullif(total, 0)")
    summed = running(counts, ["d"], "v", ["n"]).withColumn("total", F.element_at(size, F.col("d")))
    ranks = settled(summed.select("d", "v", "times", below.alias("rank")))
    small = sum(r["kinds"] for r in sums.values()) <= RANKS
    out = rows
    for c in detectors:
        own = ranks.filter(F.col("d") == c).select("v", "times", "rank")
        out = _looked_up(out, own, c, f"r_{c}", sums[c]["times"] if c in sums else 0, small)
    return out


def blend(weights: dict[str, float] = WEIGHTS, prefix: str = "r_") -> Column:
    """Weighted sum in the order of the weights."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"{prefix}{d}") for d, w in weights.items()])


def suppressed(base: Column, guard: Column, threshold: float = E_THRESHOLD) -> Column:
    """Half the score if the guard logit is below the threshold and the score above one half; both strict."""
    return F.when((guard < threshold) & (base > E_FLOOR), base * E_FACTOR).otherwise(base)


#: Tiers of suppression, deepest last: below the threshold, the total factor. Fixed values.
TIERS = ((-3.0, 0.5), (-4.5, 0.3), (-5.5, 0.1))


def suppressed_in_tiers(base: Column, guard: Column, tiers: tuple[tuple[float, float], ...] = TIERS) -> Column:
    factor = reduce(lambda otherwise, t: F.when(guard < t[0], F.lit(t[1])).otherwise(otherwise), tiers, F.lit(1.0))
    return F.when((base > E_FLOOR) & guard.isNotNull(), base * factor).otherwise(base)


def fused(ev: DataFrame) -> DataFrame:
    """Ranks against inner rows, base blend, suppression, and the Platt probability."""
    d = ranked(ev, ev.filter("split = 'inner_oof'"))
    d = d.withColumn("base", blend()).withColumn("fused", suppressed(F.col("base"), F.col("m3")))
    return d.withColumn("p_fused", platt(F.col("fused"), PLATT_A, PLATT_B, PRIOR_SHIFT))


def standardised(ev: DataFrame, detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """z_<d>: logit minus the inner mean, over the inner population deviation; missing is 0 and counted in imputed."""
    fit = ev.filter("split = 'inner_oof'").agg(*[f(d).alias(f"{k}_{d}") for d in detectors for k, f in (("m", F.avg), ("sd", F.stddev_pop))])
    d = ev.join(F.broadcast(fit))
    z = {f"z_{c}": F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.expr(f"nullif(sd_{c}, 0)"), F.lit(0.0)) for c in detectors}
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in detectors])
    return d.withColumns(z).withColumn("imputed", missing).drop(*fit.columns)


def pinned(p: Column, decided: Column, failed: Column, signal: Column, key: Column) -> Column:
    """Score of the policy: decided files above the block; others inside it by signal and jitter; failures lowest."""
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), signal))
    inside = FAILED + (BLOCK - FAILED) * ((1 - JITTER) * clip + JITTER * jitter(key))
    return F.when(failed | signal.isNull() | F.isnan(signal), FAILED * jitter(key)).when(decided, determinate(p)).otherwise(inside)


def verdict(decoded: Column, speech: Column, p_fused: Column) -> Column:
    return F.when(~decoded | ~speech, "undetermined").when(p_fused >= 0.5, "synthetic").otherwise("bonafide")


#: Speech gate limits: level dBFS, flatness, voiced share, energy deviation, pitch deviation. Fixed values.
GATE = {"level": -70.0, "flatness": 0.5, "voiced": 0.05, "energy": 3.0, "pitch": 0.02}


def gate_reasons(level: Column, flatness: Column, voiced: Column, energy: Column, pitch: Column) -> Column:
    """Why a clip is not speech, in order; a silent clip has that reason only."""
    rest = F.filter(
        F.array(
            F.when(flatness > GATE["flatness"], "noise"),
            F.when(voiced < GATE["voiced"], "unvoiced"),
            F.when(energy < GATE["energy"], "steady"),
            F.when(pitch < GATE["pitch"], "monotone"),
        ),
        lambda r: r.isNotNull(),
    )
    return F.when(level < GATE["level"], F.array(F.lit("silent"))).otherwise(rest)


def decided(ev: DataFrame) -> DataFrame:
    """Flagship: fused scores, the gate (texts under 300 characters are not speech), policy score and verdict."""
    d = fused(ev).withColumn("is_speech", F.col("n_chars") >= 300)
    score = pinned(F.col("p_fused"), F.col("is_speech"), F.col("n_chars") == 0, sigmoid(F.col("s1")), F.col("path"))
    return d.withColumn("probability", score).withColumn("verdict", verdict(F.col("n_chars") > 0, F.col("is_speech"), F.col("p_fused")))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key group in the order, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
