"""Hash of a whole table of files, as a tree of hashes with a fixed fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled

#: A node has up to FAN children, one for each next hex digit of the hash of a path; leaves hold about LEAF files.
FAN, LEAF = 16, 256


def depth_of(n: int) -> int:
    depth = 0
    while n > LEAF * FAN**depth:
        depth += 1
    return depth


def _joined(key: str, line: Column) -> Column:
    """SHA-256 of the lines in order of `key`, then of themselves."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["l"]), ""), 256)


def tree_hash(files: DataFrame, path: str, sha: str, depth: int | None = None) -> DataFrame:
    """One row (depth, n, tree): equal for equal sets of (path, sha), in whatever order and partitions.

    Files are dealt by the first `depth` hex digits of their path's SHA-256 (None: so that a leaf holds about LEAF
    files). A leaf's hash is that of its lines "path NUL sha NUL number of such rows LF", sorted by path hash; that of
    a node above is of the lines "prefix NUL hash LF" of its children, and the root's is the result. Null paths and
    hashes count as empty. No files: the hash of nothing.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = files.select(text(path).alias("p"), text(sha).alias("s")).groupBy("p", "s").agg(F.count("*").alias("c"))
    rows = settled(rows.withColumn("k", F.sha2("p", 256)))
    n, kinds = rows.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    depth = depth_of(kinds) if depth is None else depth
    line = F.concat("p", F.lit("\0"), "s", F.lit("\0"), F.col("c").cast("string"), F.lit("\n"))
    level = rows.groupBy(F.substring("k", 1, depth).alias("prefix")).agg(_joined("k", line).alias("hash"))
    for d in range(depth - 1, -1, -1):
        child = F.concat("prefix", F.lit("\0"), "hash", F.lit("\n"))
        level = level.groupBy(F.substring("prefix", 1, d).alias("up")).agg(_joined("prefix", child).alias("hash")).withColumnRenamed("up", "prefix")
    root = level.agg(F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("tree"))
    return root.select(F.lit(depth).alias("depth"), F.lit(n).cast("long").alias("n"), "tree")
