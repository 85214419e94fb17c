"""Writers: checked submissions, exports, resumable shards and documents. None overwrites what exists."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import finite
from plumbline.functions.strict import strict_json
from plumbline.operators import merkle
from plumbline.operators.expect import document_problem


class Refused(ValueError):
    """A write that a check has stopped; nothing was written."""


def checked_scores(d: DataFrame, key: str, score: str, high: float = 1.0) -> None:
    n, kinds, bad = d.agg(F.count("*"), F.count_distinct(key), F.count_if(~(finite(F.col(score)) & F.col(score).between(0.0, high)))).first()
    if not n or n != kinds or bad:
        raise Refused(f"{n} rows, {kinds} keys, {bad} scores out of range or not finite")


def submission(d: DataFrame, path: str, *, order: str = "ord", key: str = "filename", score: str = "cm-score") -> DataFrame:
    """Tab-separated, numbered part files in template order, under `path` only if what is read back is what was meant.

    The parts are written and compared in a folder beside `path`, which is renamed at the end or removed. Returns what was read.
    """
    checked_scores(d, key, score)
    spark, schema = d.sparkSession, f"`{key}` string, `{score}` double"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, aside = hadoop(path), hadoop(f"{path}.{uuid.uuid4().hex}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    d.orderBy(order).select(key, score).write.csv(aside.toString(), sep="\t", header=True, mode="errorifexists")
    back = spark.read.csv(aside.toString(), sep="\t", header=True, schema=schema)
    if d.select(key, score).exceptAll(back).limit(1).count():
        files.delete(aside, True)
        raise Refused("what was read back differs")
    if not files.rename(aside, target):
        raise OSError(f"cannot rename to {path}")
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def constants(d: DataFrame, path: str, text: str, names: tuple[str, ...]) -> None:
    """The only row's document of fusion constants, checked; an existing path is an error."""
    rows = d.select(text).limit(2).collect()
    problem = "one document is wanted" if len(rows) != 1 else document_problem(d.sparkSession, rows[0][0], names)
    if problem:
        raise Refused(problem)
    d.select(F.col(text).alias("value")).write.text(path)


def export(d: DataFrame, path: str) -> None:
    """Score export; paths must be unique. Failed rows may have null scores."""
    n, kinds = d.agg(F.count("*"), F.count_distinct("path")).first()
    if n != kinds:
        raise Refused(f"{n - kinds} repeated paths")
    d.select("path", "fold", "split", "score", "logit").write.csv(path, header=True, mode="errorifexists")


def documents(d: DataFrame, path: str, identity: str) -> None:
    """A JSON document for each row, under a folder that names the run's identity; NaN and infinities become null at any depth."""
    d.select(strict_json(d).alias("value")).write.mode("append").text(f"{path}/identity={identity}")


#: What stands between the two sizes of a WAV header: 16-bit PCM, one channel, 16 kHz.
FORMAT = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data"


def bundle(clips: DataFrame, path: str, *, key: str = "id", samples: str = "samples") -> str:
    """Recordings of (key, 16-bit samples as bytes) as a folder that moves as one; returns its tree hash.

    `clips` holds each recording with its header, number of samples and PCM hash, `meta` the hash over all names and
    PCM hashes. Keys must be present and unique, samples whole. The folder is written beside `path`, read back and
    compared, and renamed; an existing path is an error and a failed check leaves nothing.
    """
    d = clips.select(F.col(key).cast("string").alias("id"), F.col(samples).alias("pcm"))
    n, kinds, odd = d.agg(F.count("*"), F.count_distinct("id"), F.count_if(F.col("pcm").isNull() | (F.octet_length("pcm") % 2 == 1))).first()
    if n != kinds or odd:
        raise Refused(f"{n} recordings, {kinds} keys, {odd} without whole samples")
    spark = d.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, aside = hadoop(path), hadoop(f"{path}.{uuid.uuid4().hex}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    big = lambda c: F.lpad(F.hex(c), 8, "0")
    little = lambda c: F.unhex(F.concat(*[F.substring(big(c), i, 2) for i in (7, 5, 3, 1)]))
    size = F.octet_length("pcm")
    whole = F.concat(F.lit(b"RIFF"), little(size + 36), F.lit(FORMAT), little(size), F.col("pcm"))
    made = d.select("id", whole.alias("content"), F.floor(size / 2).cast("long").alias("n_samples"), F.sha2("pcm", 256).alias("pcm_sha256"))
    made.write.parquet(f"{aside.toString()}/clips")
    tree = merkle.tree_hash(d.select("id", F.sha2("pcm", 256).alias("sha")), "id", "sha")
    tree.write.json(f"{aside.toString()}/meta")
    if not bundle_ok(spark, aside.toString()):
        files.delete(aside, True)
        raise Refused("what was read back differs")
    if not files.rename(aside, target):
        raise OSError(f"cannot rename to {path}")
    return tree.first()["tree"]


def bundle_ok(spark: SparkSession, path: str) -> bool:
    """Whether a bundle's recordings still hash, from their bytes, to what its meta says."""
    meta = spark.read.schema("depth int, n long, tree string").json(f"{path}/meta").collect()
    pcm = F.sha2(F.substring("content", 45, 2**31 - 1), 256)
    have = merkle.tree_hash(spark.read.parquet(f"{path}/clips").select("id", pcm.alias("sha")), "id", "sha").first()
    return len(meta) == 1 and (meta[0]["n"], meta[0]["tree"]) == (have["n"], have["tree"])


def new_shards(d: DataFrame, path: str, key: str, shard: str) -> int:
    """Append the shards of `d` that the table lacks; returns how many rows were new."""
    spark = d.sparkSession
    try:
        have = spark.read.parquet(path).select(shard).distinct()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = None
    todo = d if have is None else d.join(have, shard, "left_anti")
    n = todo.count()
    if n:
        todo.repartition(shard).sortWithinPartitions(key).write.partitionBy(shard).mode("append").parquet(path)
    return n


def run_log(spark, path: str, **fields: object) -> None:
    """Append one line to a log table."""
    row = {k: None if v is None else str(v) for k, v in fields.items()}
    spark.range(1).select(F.current_timestamp().alias("at"), *[F.lit(v).cast("string").alias(k) for k, v in row.items()]).write.mode("append").parquet(path)
