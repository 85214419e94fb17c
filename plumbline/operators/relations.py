"""Relational building blocks over score tables and manifests."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.functions.prefix import group_quantiles, running
from plumbline.functions.scalars import basename


def without_families(rows: DataFrame, families: list[tuple[str, str]], fold_col: str, name_col: str) -> DataFrame:
    """Rows whose name holds none of the terms that are excluded for their fold; the list is short and fixed."""
    hit = reduce(lambda a, b: a | b, [(F.col(fold_col) == fold) & F.upper(name_col).contains(term) for fold, term in families])
    return rows.filter(~F.coalesce(hit, F.lit(False)))


def left_by_path_or_name(files: DataFrame, labels: DataFrame, path_col: str, id_col: str) -> DataFrame:
    """Left join on the path; if any label id has no path, on the base name of the path instead."""
    lost = labels.join(files, labels[id_col] == files[path_col], "left_anti").limit(1).count()
    key = basename(files[path_col]) if lost else files[path_col]
    return files.join(labels, key == labels[id_col], "left")


def common_rows(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys present in every part."""
    return reduce(lambda a, b: a.join(b, keys), parts)


def aligned(order: DataFrame, values: DataFrame, key: str, fill: dict[str, object]) -> DataFrame:
    """The keys of `order` with their values, or the fill value."""
    return order.join(values, key, "left").na.fill(fill)


def resolved(wanted: DataFrame, files: DataFrame, want: str, path: str) -> DataFrame:
    """(want, found): the file of that path, else the only one whose path the wanted one ends with, else null.

    A wanted path with several such files raises an error when it is read.
    """
    tail = F.concat_ws("/", F.slice(F.split(want, "/"), -2, 2))
    w = wanted.withColumn("_tail", F.when(F.size(F.split(want, "/")) >= 2, tail).otherwise(F.col(want)))
    exact = w.join(files.withColumnRenamed(path, "_exact"), F.col(want) == F.col("_exact"), "left")
    by_tail = files.groupBy(F.concat_ws("/", F.slice(F.split(path, "/"), -2, 2)).alias("_key")).agg(F.min(path).alias("_one"), F.count("*").alias("_n"))
    both = exact.join(by_tail, F.col("_tail") == F.col("_key"), "left")
    one = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("ambiguous: "), F.col(want)))).otherwise(F.col("_one"))
    return both.select(want, F.when(F.col("_exact").isNotNull(), F.col("_exact")).otherwise(one).alias("found"))


def capped(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group in a total order; the limit is pushed below the shuffle."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= most).drop("_rank")


def draw(key: str, seed: int = 0) -> Column:
    """A hash that orders rows as a seeded shuffle would."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sampled(rows: DataFrame, keys: list[str], key: str, most: int | None, seed: int = 0) -> DataFrame:
    """At most so many rows of each group, drawn by hash of a unique key; with no limit, all rows with their _rank."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(draw(key, seed), key)))
    return ranked if most is None else ranked.filter(F.col("_rank") <= most).drop("_rank")


def drawn_groups(rows: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """A rounded share of the distinct groups, drawn by hash."""
    place = F.conv(F.substring(draw(group, seed), 1, 13), 16, 10).cast("double")
    return lowest_fraction(rows.select(group).distinct().withColumn("_place", place), "_place", group, share).select(group)


def lowest_fraction(rows: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The rounded share of rows with the lowest (score, key); rows without a score are left out.

    The score at which the share is reached is found on counts of distinct scores; only rows that tie with it are
    sorted.
    """
    counts = rows.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"))
    want = int((counts.agg(F.sum("n")).first()[0] or 0) * share + 0.5)
    reached = running(counts, [], score, ["n"]).filter(F.col("run_n") >= want)
    cut = reached.agg(F.min(F.struct(F.col(score).alias("at"), (F.col("run_n") - F.col("n")).alias("before"))).alias("c")).first()["c"]
    if not want or cut is None:
        return rows.limit(0)
    ties = rows.filter(F.col(score) == cut["at"]).orderBy(key).limit(want - cut["before"])
    return rows.filter(F.col(score) < cut["at"]).unionByName(ties)


#: So many undominated points of a table's partitions are broadcast to its rows at most.
POINTS = 10_000


def _skyline(batches):
    """Points that no other point of the task is at most equal to in all cells and below in one."""
    held = None
    for pdf in batches:
        points = pdf.to_numpy(dtype=float)
        points = np.unique(points if held is None else np.vstack([held, points]), axis=0)
        kept: list[np.ndarray] = []
        for p in points:  # sorted by the first cell, so that only points before can dominate
            if not any((k <= p).all() for k in kept):
                kept.append(p)
        held, names = np.array(kept).reshape(-1, points.shape[1]), list(pdf.columns)
    if held is not None:
        yield pd.DataFrame(held, columns=names)


def undominated(rows: DataFrame, cells: list[str]) -> DataFrame:
    """Rows that no other row is at most equal to in all cells and below in one; a row with a null cell stays.

    Each task first finds the undominated points of its own rows; rows are compared with those, not with each other.
    """
    points = rows.select(*[F.col(c).cast("double").alias(f"_{c}") for c in cells]).dropna()
    front = settled(points.mapInPandas(_skyline, points.schema))
    y = F.broadcast(front) if front.count() <= POINTS else front
    x = rows.alias("x")
    no_worse = reduce(lambda a, b: a & b, [F.col(f"_{c}") <= F.col(f"x.{c}") for c in cells])
    better = reduce(lambda a, b: a | b, [F.col(f"_{c}") < F.col(f"x.{c}") for c in cells])
    return x.join(y, no_worse & better, "left_anti")


def first_source(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, prio): each key with the place of the first part that has it."""
    marked = [p.withColumn("prio", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, marked).groupBy(*keys).agg(F.min("prio").alias("prio"))


def partition_replaced(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`base` with every value of `key` that `new` has taken from `new`."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)


def matched_variants(rows: DataFrame, variant: str, stats: list[str], target: Column, holes: list[str], baseline: str, skip: list[str], improvement: float = 0.2) -> DataFrame:
    """(variant, n_stats, distance, nearer, holes_nearer, matches, place): which variant of the rows looks like the target rows.

    distance is the mean over statistics of the gap of medians in units of the target's quartile range; a statistic
    without a range there is left out. A variant matches if it is nearer than the baseline by `improvement` and its
    gap is below the baseline's in each of `holes`. The baseline and the variants to `skip` are not candidates.
    Candidates are placed by distance, then by name. Rows with a null variant and null statistics are left out.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in stats])
    long = rows.select(F.col(variant).alias("variant"), F.coalesce(target, F.lit(False)).alias("target"), F.explode(pairs).alias("p")).select("variant", "target", "p.*")
    goal = group_quantiles(long.filter("target"), ["stat"], "v", {"goal": 0.5, "q1": 0.25, "q3": 0.75}).withColumn("range", F.col("q3") - F.col("q1")).select("stat", "goal", "range")
    own = group_quantiles(long.filter("not target and variant is not null"), ["variant", "stat"], "v", {"m": 0.5}).select("variant", "stat", "m")
    gaps = own.join(goal, "stat").withColumn("gap", F.abs(F.col("m") - F.col("goal")))
    used = F.when(F.col("range") > 1e-9, F.col("gap") / F.col("range"))
    hole = [F.max(F.when(F.col("stat") == h, F.col("gap"))).alias(f"hole{i}") for i, h in enumerate(holes)]
    table = gaps.groupBy("variant").agg(F.count(used).alias("n_stats"), F.avg(used).alias("distance"), *hole)
    base = table.filter(F.col("variant") == baseline).select(F.col("distance").alias("base"), *[F.col(f"hole{i}").alias(f"base{i}") for i in range(len(holes))])
    nearer = F.coalesce(F.col("distance") <= (1 - improvement) * F.col("base"), F.lit(False))
    holes_nearer = F.coalesce(reduce(lambda a, b: a & b, [F.col(f"hole{i}") < F.col(f"base{i}") for i in range(len(holes))], F.lit(True)), F.lit(False))
    rest = table.filter(~F.col("variant").isin(baseline, *skip)).join(F.broadcast(base))  # one row
    place = F.row_number().over(Window.orderBy(F.col("distance").isNull(), F.round("distance", 12), "variant"))  # a row for each variant
    return rest.select("variant", "n_stats", "distance", nearer.alias("nearer"), holes_nearer.alias("holes_nearer"), (nearer & holes_nearer).alias("matches"), place.alias("place"))
