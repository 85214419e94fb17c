"""Draws from the values of a table in row order, and batches by length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.functions.prefix import running
from plumbline.functions.scalars import jitter

#: Places of order statistics are joined in buckets of so many.
WIDTH = 64


def numbered(rows: DataFrame, order: str, ties: list[str] | None = None, name: str = "row") -> DataFrame:
    """`rows` plus their number from 0, in the order of a number and then of `ties`; numbered over ranges."""
    made = running(rows.withColumn("_one", F.lit(1)), [], order, ["_one"], ties=ties)
    return made.withColumn(name, F.col("run__one") - 1).drop("_one", "run__one")


def order_statistic(rows: DataFrame, place: str, values: DataFrame, value: str, name: str) -> DataFrame:
    """`rows` plus `name`: the value of which `place` values are smaller or before it in their order, null beyond the last.

    Values are counted first, so a value that most rows have is one interval of places. Null values are not counted.
    """
    counts = settled(values.select(F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count("*").alias("_n")))
    spans = running(counts, [], "_v", ["_n"]).select(F.col("_v").alias(name), (F.col("run__n") - F.col("_n")).alias("_low"), F.col("run__n").alias("_high"))
    bucket = lambda c: F.floor(c / WIDTH)
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high") - 1))))
    d, s = rows.withColumn("_at", bucket(F.col(place))).alias("d"), spans.alias("s")
    on = (F.col("d._at") == F.col("s._bucket")) & (F.col(f"d.{place}") >= F.col("s._low")) & (F.col(f"d.{place}") < F.col("s._high"))
    return d.join(s, on, "left").select(*[F.col(f"d.`{c}`") for c in rows.columns], F.col(f"s.{name}"))


def drawn(rows: DataFrame, values: DataFrame, value: str, name: str, draw: Column) -> DataFrame:
    """`rows` plus `name`: any of the values, at the place that `draw`, a number from 0 to below 1, picks of all of them."""
    n = values.filter(F.col(value).isNotNull()).count()
    placed = rows.withColumn("_place", F.least(F.floor(draw * n), F.lit(n - 1)).cast("long"))
    return order_statistic(placed, "_place", values, value, name).drop("_place")


def crop_plan(rows: DataFrame, order: str, values: DataFrame, value: str, seed: int = 0) -> DataFrame:
    """`rows` plus row, crop_s and offset_seed: a length drawn for each row by its number, and a seed of its own for the offset.

    Every row draws, so that a part of the rows is cropped as in a run over all. `order` must be a distinct number.
    """
    d = numbered(rows, order)
    made = drawn(d, values, value, "crop_s", jitter(F.concat(F.lit(f"crop:{seed}:"), F.col("row").cast("string"))))
    return made.withColumn("offset_seed", F.col("row") + seed)


def mixed_lengths(rows: DataFrame, order: str, values: DataFrame, value: str, seed: int = 0, share: float = 0.7, low: float = 3.0, high: float = 14.0) -> DataFrame:
    """`rows` plus row and seconds: in `share` of the rows one of the values held to low..high, else a uniform length."""
    d = numbered(rows, order)
    u, v, w = (jitter(F.concat(F.lit(f"{k}:{seed}:"), F.col("row").cast("string"))) for k in ("mix", "len", "uni"))
    made = drawn(d, values, value, "_drawn", v)
    held = F.least(F.lit(high), F.greatest(F.lit(low), F.col("_drawn")))
    return made.withColumn("seconds", F.when((u < share) & F.col("_drawn").isNotNull(), held).otherwise(low + (high - low) * w)).drop("_drawn")


def length_batches(rows: DataFrame, key: str, length: str, budget: int, padding: float = 0.1, seed: int = 0) -> DataFrame:
    """(batch, place, key, length): rows by falling length, packed into batches of about `budget` in all.

    Lengths are put into classes in which the shortest is over 1 - padding of the longest; a batch never leaves its
    class, so padded to its longest row it wastes less than `padding`. Inside a class rows go by length, a hash and
    the key; a row starts a new batch when those before it in the class have passed a multiple of the budget, so a
    batch is less than one row over it. Lengths are whole; those below 1 count as 1 and null ones are left out.
    """
    step = -math.log(1 - padding)
    size = F.greatest(F.col(length).cast("long"), F.lit(1).cast("long"))
    d = rows.filter(F.col(length).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), size.alias("_size"))
    d = d.withColumns({"_class": F.floor(F.log(F.col("_size").cast("double")) / step), "_order": jitter(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string"))) - F.col("_size"), "_one": F.lit(1)})
    packed = running(settled(d), ["_class"], "_order", ["_size", "_one"], ties=["_key"])
    packed = packed.withColumn("_in", F.floor((F.col("run__size") - F.col("_size")) / budget))
    batches = packed.groupBy("_class", "_in").agg(F.min("run__one").alias("_first"))
    longer = Window.orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    own = batches.groupBy("_class").agg(F.count("*").alias("_batches"))  # a row for each class: logarithms of lengths
    heads = own.select("_class", F.coalesce(F.sum("_batches").over(longer), F.lit(0)).alias("_head"))
    starts = running(batches.withColumns({"_b": F.lit(1), "_at": F.col("_in").cast("double")}), ["_class"], "_at", ["_b"]).select("_class", "_in", "_first", (F.col("run__b") - 1).alias("_number"))
    joined = packed.join(starts, ["_class", "_in"]).join(F.broadcast(heads), "_class")
    return joined.select((F.col("_head") + F.col("_number")).alias("batch"), (F.col("run__one") - F.col("_first")).alias("place"), F.col("_key").alias(key), F.col("_size").alias(length))
