"""Streaming wrappers: score and document files as they arrive, and keep running decision counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.strict import strict_json
from plumbline.operators.features import decode_stats, features
from plumbline.sources.readers import SUFFIXES

CLIP = "path string, modificationTime timestamp, length long, content binary"


def clip_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings that appear in a folder, each once."""
    return spark.readStream.format("binaryFile").schema(CLIP).option("maxFilesPerTrigger", 1000).load(folder)


def score_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, families: list[str]):
    """Write the features of arriving recordings; the checkpoint makes a restarted run go on where it stopped."""
    rows = features(clip_stream(spark, folder), families)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: What is said of a recording that cannot be judged. Fixed value.
UNDETERMINED = "undetermined"
MEASURED = "struct<n_samples:bigint,peak:double,clipped:bigint>"


def judged(rows: DataFrame) -> DataFrame:
    """(path, verdict, error, measured) of each recording (path, content): what it is, or why nothing can be said."""
    d = decode_stats(rows).select("path", "status", "n_samples", "peak", "clipped")
    error = F.when(F.col("status") != "ok", F.col("status")).when(F.coalesce(F.col("n_samples"), F.lit(0)) == 0, "no samples")
    measured = F.when(error.isNull(), F.struct("n_samples", "peak", "clipped"))
    return d.select("path", F.when(error.isNull(), "decoded").otherwise(UNDETERMINED).alias("verdict"), error.alias("error"), measured.alias("measured"))


def _empty(spark: SparkSession, folder: str) -> list[str]:
    """Recordings of a folder that have no bytes; Spark's readers pass over them."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
    found = [f.getPath().toString() for f in files if f.isFile() and not f.getLen()]
    return sorted(p for p in found if p.rsplit(".", 1)[-1].lower() in SUFFIXES)


def document_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame] = judged):
    """Write a JSON document for each recording that arrives in a folder, each once, under out/batch=<number>.

    A batch's folder is overwritten as a whole, so a batch that is replayed after a crash, however far it had come,
    leaves the same documents once; the checkpoint gives it the same files again. Recordings that cannot be decoded
    get a document too; those without a byte get theirs in out/batch=empty-<hash of their path>, overwritten likewise.
    `judge` makes the documents' columns from (path, content).
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        made = judge(batch.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES)))
        made.select(strict_json(made).alias("value")).write.mode("overwrite").text(f"{out}/batch={number}")
        for path in _empty(session, folder):
            none = session.createDataFrame([(path, UNDETERMINED, "empty", None)], f"path string, verdict string, error string, measured {MEASURED}")
            name = hashlib.sha256(path.encode()).hexdigest()[:16]
            none.select(strict_json(none).alias("value")).coalesce(1).write.mode("overwrite").text(f"{out}/batch=empty-{name}")

    return clip_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, key, n, mean, share above 50) over event time; works on a stream, with late rows up to `late`, or a table."""
    d = events.withColumn(ts, F.col(ts).cast("timestamp"))
    d = d.withWatermark(ts, late) if events.isStreaming else d
    hit = (F.col(value) > 50).cast("int")
    return d.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(hit).alias("share"))
