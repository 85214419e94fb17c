"""Readers with declared schemas for the file formats that scores, manifests and recordings come in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.expect import document_problem

#: Recording suffixes that are listed. Fixed values.
SUFFIXES = ("wav", "flac", "mp3", "m4a", "ogg", "opus", "aac", "wma", "aiff", "aif")
EXPORT = "path string, fold string, split string, score double, logit double"
FOLDS = "path string, label string, generator string, speaker string, source string, group string, fold string"
PROTOCOL = "speaker string, utt string, unused string, system string, key string"


def export_csv(spark: SparkSession, path: str) -> DataFrame:
    """Score export; NaN becomes null, `stress` is read as `itw`."""
    d = spark.read.csv(path, schema=EXPORT, header=True)
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return d.select("path", "fold", F.when(F.col("split") == "stress", "itw").otherwise(F.col("split")).alias("split"), number("score"), number("logit"))


def folds_csv(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """A fold file; with a pinned hash, one file whose bytes must have it."""
    if sha256 is not None:
        have = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).limit(2).collect()]
        if have != [sha256]:
            raise ValueError(f"{path}: sha256 {have}, pinned {sha256}")
    return spark.read.csv(path, schema=FOLDS, header=True)


def piped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """|-separated table with a header, all columns as declared."""
    return spark.read.csv(path, schema=schema, sep="|", header=True)


def protocol(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated protocol without a header; system `-` is genuine speech."""
    d = spark.read.csv(path, schema=PROTOCOL, sep=" ")
    return d.select("speaker", "utt", F.when(F.col("system") == "-", "bonafide").otherwise(F.col("system")).alias("generator"), "key")


def template(spark: SparkSession, path: str) -> DataFrame:
    """(ord, filename) of a tab-separated template in file order; raises unless names are present and unique.

    A template is one small file that is read in order by one task; the order is the contract.
    """
    lines = spark.read.text(path, wholetext=False).coalesce(1).withColumn("_n", F.monotonically_increasing_id())
    first = lines.filter("_n = 0").first()
    header = first["value"].split("\t") if first else []
    if "filename" not in header:
        raise ValueError(f"no filename column in {header}")
    rows = lines.filter("_n > 0").select((F.col("_n") - 1).alias("ord"), F.split("value", "\t").getItem(header.index("filename")).alias("filename"))
    if rows.groupBy("filename").count().filter("count > 1 or filename is null").limit(1).count():
        raise ValueError("file names must be unique")
    return rows


def manifest(spark: SparkSession, path: str, column: str = "path") -> DataFrame:
    """(ord, id) of a manifest's column in file order; raises if the column is not there. One file, read by one task."""
    lines = spark.read.csv(path, header=True, inferSchema=False, multiLine=True).coalesce(1)
    if column not in lines.columns:
        raise ValueError(f"no column {column} in {lines.columns}")
    return lines.select(F.monotonically_increasing_id().alias("ord"), F.col(column).alias("id"))


def constants(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict:
    """A checked document of fusion constants; raises with what is wrong. It is small and lives on the driver."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    problem = document_problem(spark, text, names)
    if problem:
        raise ValueError(f"constants: {problem}")
    return json.loads(text)


def latest_json(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines, broken ones dropped; of lines with one key the last of the file wins."""
    marked = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    d = marked.select(F.from_json("value", schema).alias("d"), "_file", "_line").filter(f"d.`{key}` is not null")
    return d.groupBy(f"d.{key}").agg(F.max_by("d", F.struct("_file", "_line")).alias("d")).select("d.*")


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, length, content) of all recordings under a folder, ids being relative paths."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    name = F.regexp_replace("path", "^.*" + folder.rstrip("/").split("/")[-1] + "/", "")
    return d.filter(suffix.isin(*SUFFIXES)).select(name.alias("id"), "path", "length", "content")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, length) of all recordings, sorted by id; contents are not read."""
    return recordings(spark, folder).drop("content").orderBy("id", "path")


def shards(spark: SparkSession, path: str, row: str = "row") -> DataFrame:
    """Sharded rows in the order of their numbers, which must be exactly 0 to n - 1; raises otherwise."""
    d = spark.read.parquet(path)
    n, low, high, kinds = d.agg(F.count("*"), F.min(row), F.max(row), F.count_distinct(row)).first()
    if n and not (low == 0 and high == n - 1 and kinds == n):
        raise ValueError(f"rows {low} to {high}, {kinds} different of {n}")
    return d.orderBy(row)


def head_of_each(d: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_r") <= n).drop("_r")
