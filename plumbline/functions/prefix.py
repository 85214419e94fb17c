"""Running sums in the order of a number, without one task for each group.

Rows are put into value ranges by approximate quantiles, each range's sums are prefixed on a table of at most
groups x ranges rows, and only the rest is a window inside a range. Ranges do not change results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled

RANGES = 64


def _free(df: DataFrame, *stems: str) -> list[str]:
    """Names that no column of `df` has or begins with, so that a caller's columns never clash with working ones."""
    taken = [c.lower() for c in df.columns]
    return ["_" * (1 + max((len(c) - len(c.lstrip("_")) for c in taken), default=0)) + s for s in stems]


def cuts_of(df: DataFrame, cols: list[str], ranges: int = RANGES) -> list[list[float]]:
    """Range borders of each column, by one pass."""
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    row = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [sorted(set(c or [])) for c in row]


def running(df: DataFrame, keys: list[str], order: str, values: list[str], cuts: list[float] | None = None, ties: list[str] | None = None) -> DataFrame:
    """`df` plus run_<v> for each value: its sum over rows of the same keys up to and with the row's order value.

    `order` and `ties` together must be distinct inside a group of keys; ranges are cut by `order` alone. Null keys
    are a group; rows with a null order come first.
    """
    cuts = cuts_of(df, [order])[0] if cuts is None else cuts
    at, head = _free(df, "part", "head")
    part = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(f"`{order}`"))) if cuts else F.lit(0)
    placed = df.withColumn(at, F.coalesce(part, F.lit(0)))
    sums = placed.groupBy(*keys, at).agg(*[F.sum(v).alias(f"{head}_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(*keys, at, *[F.coalesce(F.sum(f"{head}_{v}").over(before), F.lit(0)).alias(f"{head}_{v}") for v in values])
    d, h = placed.alias("d"), heads.alias("h")
    on = F.col(f"d.{at}") == F.col(f"h.{at}")
    for k in keys:
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}"))
    inside = Window.partitionBy(*[F.col(f"d.{k}") for k in keys], F.col(f"d.{at}")).orderBy(*[F.col(f"d.{c}") for c in (order, *(ties or []))]).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(h, on).select("d.*", *[(F.sum(f"d.{v}").over(inside) + F.col(f"h.{head}_{v}")).alias(f"run_{v}") for v in values]).drop(at)


def following(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """`df` plus next_<v> for each value: that of the next row of the same keys in order, null for the last.

    `order` must be distinct inside a group of keys and not null. Rows look inside their range only; a range's last
    row looks at the first row of the next range of its keys, from a table of at most groups x ranges rows.
    """
    cuts = cuts_of(df, [order])[0]
    at, first, then, own = _free(df, "part", "first", "next", "own")
    part = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    placed = df.withColumn(at, part)
    heads = placed.groupBy(*keys, at).agg(F.min_by(F.struct(*values), order).alias(first))
    heads = heads.select(*keys, at, F.lead(first).over(Window.partitionBy(*keys).orderBy(at)).alias(then))
    d, h = placed.alias("d"), heads.alias("h")
    on = F.col(f"d.{at}") == F.col(f"h.{at}")
    for k in keys:
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}"))
    inside = Window.partitionBy(*[F.col(f"d.{k}") for k in keys], F.col(f"d.{at}")).orderBy(F.col(f"d.{order}"))
    found = F.coalesce(F.lead(F.struct(*[F.col(f"d.{v}") for v in values])).over(inside), F.col(f"h.{then}"))
    return d.join(h, on).select("d.*", found.alias(own)).select("*", *[F.col(f"{own}.{v}").alias(f"next_{v}") for v in values]).drop(at, own)


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact quantile of `value` for each named share, in proportion between two neighbours.

    Values are counted and the counts summed over ranges, so that no task holds all of them. Nulls are left out;
    without values the quantiles are null.
    """
    counts = settled(df.select(F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    summed = running(counts, [], "_v", ["_n"])
    made = []
    for name, share in shares.items():
        place = share * (total - 1)
        low, high = (F.min(F.when(F.col("run__n") > rank, F.col("_v"))) for rank in (math.floor(place), math.ceil(place)))
        made.append((low + (high - low) * (place - math.floor(place))).alias(name))
    return summed.agg(*made)


def group_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, <name>): exact quantiles of `value` inside each group, in proportion between two neighbours.

    As quantiles(), by counts of distinct values over ranges, so that a group that most rows are in is not one task.
    Null keys are a group; groups without values are left out.
    """
    counts = settled(df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n")))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    s, t = running(counts, keys, "_v", ["_n"]).alias("s"), totals.alias("t")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
    summed = s.join(t, same).select("s.*", "t.n")
    made = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("n") - 1)
        low, high = (F.min(F.when(F.col("run__n") > rank, F.col("_v"))) for rank in (F.floor(place), F.ceil(place)))
        made.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return summed.groupBy(*keys, "n").agg(*made)
