"""Rules on what a candidate gains, readings of probes, and columns that a cache may lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import AVERSE, BRIEF, finite
from plumbline.operators import metrics as me

#: Gains that a candidate with room shows in the wild, and its new catches. Fixed values.
ROOM = {"itw_brief_gain": 0.030, "itw_averse_gain": 0.030, "catches": 19}
#: The standing rule: a gain in the wild and the losses that are let pass elsewhere. Fixed values.
STANDING = {"itw_brief_gain": 0.01, "itw_averse_reg": 0.01, "holdout_brief_reg": 0.05, "inner_brief_reg": 0.03}
#: What a comparison lets pass of the error of its numbers. Fixed value.
EPS = 1e-12


def failed(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold, joined by commas; one without an answer does not hold."""
    return F.concat_ws(",", *[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in rules.items()])


def with_columns_of(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """`rows` plus the wanted columns that it lacks, all null, so that a cache of nothing but errors can be read out."""
    have = {c.lower() for c in rows.columns}
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c.lower() not in have})


def gains(ev: DataFrame, candidates: list[str], old: str) -> DataFrame:
    """(candidate, itw_brief, itw_averse, holdout_brief, inner_brief, catches) of each candidate against the old score.

    Gains are differences of least costs, four decimals of each; catches are positives in the wild that the old score
    misses at 0 and the candidate finds.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.round(F.col(c), 9).alias("score")) for c in (old, *candidates)]))
    rows = ev.filter("y is not null").select("split", "y", stack.alias("s")).select("split", "y", "s.*")
    costs = me.min_dcf(rows, ["candidate", "split"], BRIEF).select("candidate", F.concat("split", F.lit("_brief")).alias("cell"), F.round("min_dcf", 4).alias("cost"))
    averse = me.min_dcf(rows.filter("split = 'itw'"), ["candidate"], AVERSE).select("candidate", F.lit("itw_averse").alias("cell"), F.round("min_dcf", 4).alias("cost"))
    cells = {"itw_brief": "itw_brief", "itw_averse": "itw_averse", "holdout_brief": "holdout_brief", "inner_oof_brief": "inner_brief"}
    wide = costs.unionByName(averse).groupBy("candidate").pivot("cell", list(cells)).agg(F.max("cost"))
    now = wide.filter(F.col("candidate") == old).select(*[F.col(c).alias(f"old_{c}") for c in cells])
    gained = wide.filter(F.col("candidate") != old).join(F.broadcast(now))  # one row
    gained = gained.select("candidate", *[(F.col(f"old_{c}") - F.col(c)).alias(name) for c, name in cells.items()])
    wild = ev.filter("split = 'itw' and y = 1")
    found = wild.agg(*[F.count_if((F.col(old) < 0) & (F.col(c) >= 0)).alias(c) for c in candidates])
    return gained.join(F.broadcast(found.unpivot([], candidates, "candidate", "catches")), "candidate")


def ruled(gained: DataFrame) -> DataFrame:
    """`gained`, rows of gains(), plus room_failed, room, standing_failed and standing.

    A rule whose figure is null has failed.
    """
    at_least = lambda c, bound: F.col(c) >= bound - EPS
    room = failed({
        "itw_brief_gain": at_least("itw_brief", ROOM["itw_brief_gain"]),
        "itw_averse_gain": at_least("itw_averse", ROOM["itw_averse_gain"]),
        "catches": F.col("catches") >= ROOM["catches"],
    })
    standing = failed({
        "itw_brief_gain": at_least("itw_brief", STANDING["itw_brief_gain"]),
        "itw_averse_reg": at_least("itw_averse", -STANDING["itw_averse_reg"]),
        "holdout_brief_reg": at_least("holdout_brief", -STANDING["holdout_brief_reg"]),
        "inner_brief_reg": at_least("inner_brief", -STANDING["inner_brief_reg"]),
    })
    d = gained.withColumns({"room_failed": room, "standing_failed": standing})
    verdict = lambda c: F.when(F.col(c) == "", "PASS").otherwise("FAIL")
    return d.withColumns({"room": verdict("room_failed"), "standing": verdict("standing_failed")})


def probe_cells(cells: DataFrame) -> DataFrame:
    """(candidate, kind, n, n_errors, auc, brief, averse) of long rows (candidate, kind, y, score).

    Rows without a finite score are errors, counted and left out; a cell of nothing but errors has null figures.
    """
    rows = cells.withColumn("score", F.when(finite(F.col("score")), F.col("score")))
    keys = ["candidate", "kind"]
    n = me.masked_report(rows, keys).select(*keys, (F.col("n") - F.col("n_masked")).alias("n"), F.col("n_masked").alias("n_errors"), "auc", F.col("min_dcf").alias("brief"))
    return n.join(me.min_dcf(rows, keys, AVERSE).withColumnRenamed("min_dcf", "averse"), keys, "left")


def probe_reading(cells: DataFrame, clean: str, noisy: str, reference: str, least: float, tolerance: float) -> DataFrame:
    """(candidate, clean_auc, noisy_auc, reading) of rows of probe_cells().

    PASS: the noisy cell reaches `least` and the clean one is no more than `tolerance` below the reference's clean
    cell. FAIL otherwise, and inconclusive where a cell, the reference's too, has no figure.
    """
    own = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("auc")))
    d = cells.groupBy("candidate").agg(own(clean).alias("clean_auc"), own(noisy).alias("noisy_auc"))
    known = cells.filter((F.col("candidate") == reference) & (F.col("kind") == clean)).agg(F.max("auc").alias("known"))
    passed = (F.col("noisy_auc") >= least) & (F.col("clean_auc") >= F.col("known") - tolerance - EPS)
    lacking = F.col("clean_auc").isNull() | F.col("noisy_auc").isNull() | F.col("known").isNull()
    reading = F.when(lacking, "inconclusive").when(passed, "PASS").otherwise("FAIL")
    return d.join(F.broadcast(known)).select("candidate", "clean_auc", "noisy_auc", reading.alias("reading"))  # one row


def self_check(rows: DataFrame, stored: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, n, drift): on how many keys both tables have a finite score, and the largest difference there."""
    a = rows.filter(finite(F.col("score"))).select(*keys, F.col("score").alias("_a"))
    b = stored.filter(finite(F.col("score"))).select(*keys, F.col("score").alias("_b"))
    return a.join(b, keys).groupBy(by).agg(F.count("*").alias("n"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("drift"))
