"""Shared pieces: table access, checkpoints in the cluster's shared folder, word counts, Arrow batch slicing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words of the corpus contracts: runs of anything but space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the cluster's shared folder.

    Shuffle files of the finished plan are given back at once, so that a query of several phases needs the disk of
    its largest one; a lost task before that is run again from them.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return settled(df.select("*"))  # a new plan: the setting is read when one is made
    finally:
        spark.conf.set(CLEANUP, before)


def word_count(text: Column) -> Column:
    """Number of WORD matches in a text; null counts as 0. One regex pass, no array of words is built."""
    marks = F.regexp_replace(text, WORD, "w")
    return F.coalesce(F.length(marks) - F.length(F.translate(marks, "w", "")), F.lit(0)).cast("long")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of `df` has, so that caller columns never clash with working ones."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about `limit` bytes of `column`, or one longer row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            n = 0 if n != n else int(n)
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes b''."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    return [b"" if v is None else v for v in values]


def pieces(text: bytes, letters: bytes, limit: int = 4 << 20) -> Iterator[bytes]:
    """A text translated by `letters`, in pieces of about `limit` bytes that end at a space or at the text's end."""
    text = text.translate(letters)
    start = 0
    while len(text) - start > limit:
        end = text.find(b" ", start + limit)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text
