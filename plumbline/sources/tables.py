"""Test tables and the evaluation view: scores, labels, splits and folds over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import jitter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: label y (null if unlabelled), group columns, split, fold and four logits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"), "quality")
    d = docs.join(labels, "doc_id", "left")
    last = F.col("doc_id") % 10
    split = F.when(F.col("y").isNull(), "test").when(last < 6, "inner_oof").when(last < 8, "holdout").otherwise("itw")
    d = d.withColumn("split", split)
    fold = F.when(F.col("split") == "test", "test").when(F.col("split") == "inner_oof", (F.col("doc_id") % 5).cast("string")).otherwise("holdout")
    return d.select(
        "doc_id",
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"),
        "y",
        "quality",
        F.col("lang").alias("generator"),
        "source",
        F.concat(F.lit("spk"), F.col("doc_id") % 17).alias("speaker"),
        "split",
        fold.alias("fold"),
        "n_chars",
        (F.log(F.col("n_chars") + 1.0) - 6.0).alias("s1"),
        (jitter(F.concat(F.lit("a"), F.col("doc_id"))) * 6.0 - 3.0).alias("s2"),
        ((F.col("doc_id") % 29) / 4.0 - 3.5).alias("s3"),
        (jitter(F.concat(F.lit("b"), F.col("doc_id"))) * 12.0 - 6.0).alias("m3"),
    )


def long_scores(ev: DataFrame, detectors: tuple[str, ...] = ("s1", "s2", "s3")) -> DataFrame:
    """(path, split, fold, source, generator, speaker, y, candidate, score), one row for each detector."""
    keep = ["path", "split", "fold", "source", "generator", "speaker", "y"]
    return ev.select(*keep, *detectors).unpivot(keep, list(detectors), "candidate", "score")


#: The evaluation view in DuckDB SQL, to stand behind WITH.
EV = """jit AS (SELECT doc_id, cast(('0x'||substr(sha1('a'||doc_id),1,16)) AS UBIGINT)::DOUBLE/18446744073709551616e0 AS ja,
  cast(('0x'||substr(sha1('b'||doc_id),1,16)) AS UBIGINT)::DOUBLE/18446744073709551616e0 AS jb FROM documents),
ev0 AS (SELECT d.doc_id, 'doc/'||d.doc_id AS path, l.toxic AS y, l.quality, d.lang AS generator, d.source, 'spk'||(d.doc_id%17) AS speaker,
  CASE WHEN l.toxic IS NULL THEN 'test' WHEN d.doc_id%10<6 THEN 'inner_oof' WHEN d.doc_id%10<8 THEN 'holdout' ELSE 'itw' END AS split,
  d.n_chars, ln(d.n_chars+1.0::DOUBLE)-6e0 AS s1, ja*6e0-3e0 AS s2, (d.doc_id%29)/4e0-3.5e0 AS s3, jb*12e0-6e0 AS m3
  FROM documents d LEFT JOIN labels l USING (doc_id) JOIN jit USING (doc_id)),
ev AS (SELECT *, CASE split WHEN 'test' THEN 'test' WHEN 'inner_oof' THEN (doc_id%5)::VARCHAR ELSE 'holdout' END AS fold FROM ev0),
scores AS (SELECT path, split, fold, source, generator, speaker, y, 's1' AS candidate, s1 AS score FROM ev
  UNION ALL SELECT path, split, fold, source, generator, speaker, y, 's2', s2 FROM ev
  UNION ALL SELECT path, split, fold, source, generator, speaker, y, 's3', s3 FROM ev)"""
