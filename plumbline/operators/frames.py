"""Operators on ordered samples (keys, pos, value): differences, local ratios, runs, frames.

Positions count from 0 inside a key. Keys are recordings, so a window holds one recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positioned(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def _by(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("pos")


def first_difference(x: DataFrame, keys: list[str], col: str) -> DataFrame:
    return x.withColumn("diff", F.col(col) - F.lag(col).over(_by(keys)))


def local_ratio(x: DataFrame, keys: list[str], col: str, before: int, after: int) -> DataFrame:
    """Magnitude over the RMS of the samples around it, itself left out."""
    w = _by(keys).rowsBetween(-before, after)
    square = F.col(col) * F.col(col)
    around, n = F.sum(square).over(w) - square, F.count("*").over(w) - 1
    return x.withColumns({"around_n": n, "ratio": F.abs(col) / (F.sqrt(F.greatest(around, F.lit(0.0)) / F.nullif(n, F.lit(0))) + 1e-9)})


def merged(hits: DataFrame, keys: list[str], pos: str, gap: int) -> DataFrame:
    """Run number of each hit: a hit more than `gap` after the one before it starts a run."""
    w = Window.partitionBy(*keys).orderBy(pos)
    fresh = F.coalesce(F.col(pos) - F.lag(pos).over(w) > gap, F.lit(True))
    return hits.withColumn("_fresh", fresh.cast("long")).withColumn("run", F.sum("_fresh").over(w)).drop("_fresh")


def running_min(x: DataFrame, keys: list[str], col: str, width: int) -> DataFrame:
    """Smallest of each sample and those after it, full windows only."""
    w = _by(keys).rowsBetween(0, width - 1)
    return x.withColumns({"low": F.min(col).over(w), "_n": F.count("*").over(w)}).filter(F.col("_n") == width).drop("_n")


def runs_of(x: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """on: the test holds; starts: it did not hold for the sample before."""
    d = x.withColumn("on", test)
    return d.withColumn("starts", F.col("on") & ~F.coalesce(F.lag("on").over(_by(keys)), F.lit(False)))


def islands(x: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """A number shared by rows with consecutive positions."""
    return x.withColumn("island", F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))


def tumbling(x: DataFrame, size: int) -> DataFrame:
    return x.withColumn("frame", F.expr(f"pos div {size}"))


def sliding(x: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """A row for each window a sample is in: windows every `hop`, and one flush with the end; short keys have none.

    A sample finds its windows by arithmetic, so no sample meets all windows of its key.
    """
    n = x.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= size)
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - (size - 1)) / hop)).cast("long")
    last = F.least(F.floor(F.col("pos") / hop), F.floor((F.col("_n") - size) / hop)).cast("long")
    regular = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * hop)).otherwise(F.array().cast("array<bigint>"))
    end = F.when(F.col("pos") >= F.col("_n") - size, F.array(F.col("_n") - size)).otherwise(F.array().cast("array<bigint>"))
    return x.join(n, keys).withColumn("start", F.explode(F.array_union(regular, end))).drop("_n")


def trimmed(x: DataFrame, keys: list[str], col: str, size: int, share: float) -> DataFrame:
    """(keys, first_frame, last_frame): frames whose RMS is at least a share of the loudest."""
    f = tumbling(x, size).groupBy(*keys, "frame").agg(F.sqrt(F.avg(F.col(col) * F.col(col))).alias("rms"), F.count("*").alias("n")).filter(F.col("n") == size)
    top = f.groupBy(*keys).agg(F.max("rms").alias("top"))
    loud = F.when(F.col("rms") >= F.col("top") * share, F.col("frame"))
    return f.join(top, keys).groupBy(*keys).agg(F.min(loud).alias("first_frame"), F.max(loud).alias("last_frame"))


def down_crossings(x: DataFrame, keys: list[str], col: str, half: int) -> DataFrame:
    """(keys, n): how often the smoothed value falls through its median."""
    s = x.withColumn("v", F.avg(col).over(_by(keys).rowsBetween(-half, half)))
    mid = s.groupBy(*keys).agg(F.percentile("v", 0.5).alias("mid"))
    both = s.join(mid, keys)
    down = (F.col("v") < F.col("mid") - 1e-9) & (F.lag("v").over(_by(keys)) >= F.col("mid") + 1e-9)
    return both.withColumn("down", down).groupBy(*keys).agg(F.count_if("down").alias("n"))
