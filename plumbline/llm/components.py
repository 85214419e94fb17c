"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed


def connected(links: DataFrame) -> DataFrame:
    """From links (a long, b long) to (node, root): the smallest node reachable; only nodes that have a link.

    Each step joins links with the smallest neighbour of their end, a partial minimum; joins on a node with very
    many links can be split. Steps are checkpointed, and their number grows as the logarithm of the graph's width.
    Loops and repeated links are dropped.
    """
    up = F.greatest("a", "b").alias("a")
    now = checkpointed(links.filter("a <> b").select(up, F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(turned.union(least.select("a", F.col("m").alias("b"))).distinct())
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
