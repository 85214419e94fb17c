"""Corpus pipeline: language, near-duplicates, benchmark leaks, source mix, shards.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept. All but the last
return the columns they were given; the last adds size, text_crc32, shard and slot. SQL cannot express language
identification, so there is no ORACLE_SQL; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, hilbert, langid, mixing, simhash
from plumbline.llm.common import checkpointed, free_name, table


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, empty and letterless ones, with labels to learn from or without."""
    model = langid.fit(langid.labelled_sample(docs, F.lit(True)))
    if not model["langs"]:
        return docs.filter(langid.lettered("text"))
    named = docs.select(*[F.col(c).alias(free_name(docs, c) if c in ("lang_pred", "score", "spans") else c) for c in docs.columns])
    judged = langid.identify(named, model).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return judged.select(*[F.col(a).alias(b) for a, b in zip(named.columns, docs.columns)])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near-duplicates, by the fingerprints of op3."""
    return simhash.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item, or a whole shorter item."""
    made = {f.name for f in decontam.MADE.fields}
    named = docs.select(*[F.col(c).alias(free_name(docs, c) if c in made else c) for c in docs.columns])
    clean = decontam.decontaminated(named, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated"))
    return clean.select(*[F.col(a).alias(b) for a, b in zip(named.columns, docs.columns)])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    made = ("size", "source_size", "target", "copies", "taken")
    named = docs.select(*[F.col(c).alias(free_name(docs, c) if c in made else c) for c in docs.columns])
    taken = mixing.mix_sources(named).filter("copies > 0").withColumn(turn := free_name(named, "turn"), F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.drop(turn).select(*[F.col(a).alias(b) for a, b in zip(named.columns, docs.columns)])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot along the Hilbert curve."""
    return hilbert.hilbert_shards(docs)


STAGES = [
    ("language", in_a_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixture", mixed),
    ("shards", sharded),
]
#: Stages whose successor reads their rows more than once; run() writes these and drops what stands before them.
SETTLED = {"language", "decontamination", "mixture"}
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Models, searches and mixes are worked out once: what is read again is written first."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name in SETTLED:
            docs = checkpointed(docs)
    return docs
