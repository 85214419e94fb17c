"""SimHash near-duplicates, candidates found by the pigeonring principle.

A fingerprint's 64 bits are a ring of four segments. If two differ in at most 3 bits, some segment starts a chain
in which the first l segments differ in at most 3 * l / 4 bits for every l: 0, 1, 2, 3. A start's exact segment and
a next one with at most one difference are matched by key: each fingerprint offers its own two segments, and asks
for them and for each setting of one zero bit in the second. The rest of the chain and then the whole Hamming
distance are checked in the join.

Copies have one fingerprint and are one row from the first aggregation on. Links are made between different
fingerprints only.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.llm.common import checkpointed, free_name, pieces
from plumbline.llm.components import connected
from plumbline.llm.rows import with_computed

MOST = 3
SEGMENTS = 4
WIDTH = 16
#: At most so many fingerprints are broadcast: those of more than one row in FEW.
FEW = 5000


#: A-Z are lower-cased, the five ASCII white-space controls become spaces, all other bytes stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return ones


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, limit: int = 4 << 20) -> int:
    """Bit-wise majority (over half) of the XXH64 of all word shingles; 0 if there is no word.

    A text is read in pieces of about `limit` bytes, each with the last words of the one before, so that the words
    and hashes of one piece are held whatever its length.
    """
    ones, count, words = np.zeros(64, np.int64), 0, []
    for piece in pieces(text, LETTERS, limit):
        words += piece.split()
        n = len(words) - shingle + 1
        if n > 0:
            runs = zip(*(words[i:] for i in range(shingle)))
            ones += _set_bits(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed)), np.uint64, n))
            count, words = count + n, words[n:]
    if not count:
        if not words:
            return 0
        ones, count = _set_bits(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)), 1
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, *, text_col: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    def start():
        one = partial(fingerprint, shingle=shingle)
        return lambda texts: {name: np.fromiter(map(one, texts), np.uint64, len(texts)).view(np.int64)}

    return with_computed(docs, text_col, StructType([StructField(name, LongType())]), start, keep)


def _key(x: np.ndarray, start: int) -> np.ndarray:
    ring = (x >> np.uint64(WIDTH * start)) | (x << np.uint64((64 - WIDTH * start) % 64)) if start else x
    return (ring & np.uint64(0xFFFFFFFF)).view(np.int64) | np.int64(start << 32)


def _asked(batches):
    """For each start of a chain: the key itself, and the key with one zero bit of the second segment set."""
    for batch in batches:
        x = batch.column(0).to_numpy().view(np.uint64)
        for start in range(SEGMENTS):
            key = _key(x, start)
            keys, fps = [key], [x]
            for bit in range(WIDTH, 2 * WIDTH):
                zero = (key >> bit) & 1 == 0
                keys.append(key[zero] | (1 << bit))
                fps.append(x[zero])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(fps).view(np.int64))], names=["key", "x"])


def _offered(batches):
    for batch in batches:
        y = batch.column(0).to_numpy().view(np.uint64)
        keys = np.concatenate([_key(y, start) for start in range(SEGMENTS)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(y.view(np.int64), SEGMENTS))], names=["key", "y"])


def links(fingerprints: DataFrame) -> DataFrame:
    """All pairs (a, b) of different fingerprints, a column `fp` of distinct longs, at most MOST bits apart."""
    ask = fingerprints.select("fp").mapInArrow(_asked, "key long, x long")
    offer = fingerprints.select("fp").mapInArrow(_offered, "key long, y long")
    apart = F.col("x").bitwiseXOR(F.col("y"))
    start = F.shiftright("p.key", 32).cast("int")
    three = (1 << (3 * WIDTH)) - 1
    masks = [sum(((three >> (WIDTH * k)) & 0xFFFF) << (WIDTH * ((s + k) % SEGMENTS)) for k in range(3)) for s in range(SEGMENTS)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    third = F.bit_count(apart.bitwiseAND(F.get(F.lit(signed), start))) <= MOST * 3 // SEGMENTS
    close = (F.col("x") != F.col("y")) & third & (F.bit_count(apart) <= MOST)
    found = ask.alias("p").join(offer.alias("q"), (F.col("p.key") == F.col("q.key")) & close)
    return found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def groups(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From checkpointed rows (id, fp) to (fp, copies, root, component_id): the smallest fingerprint and id of all reachable."""
    own = checkpointed(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")))
    roots = connected(links(own))
    linked = checkpointed(roots.join(own, roots.node == own.fp).select("fp", "root", "least"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    far = linked.join(least, "root").select("fp", "root", "component_id")
    return own.join(far, "fp", "left").select("fp", "copies", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long, component_id) for every row of `docs`.

    Null, empty and wordless texts have fingerprint 0, which links like any other. Null ids are not the smallest
    unless a component has no other; its component_id is then null. Repeated rows stay. No rows give no rows.
    """
    near = _near(docs, id_col, text_col, shingle)
    return near.select(F.col("id").alias(id_col), "fp", "component_id")


def _near(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, sum, fp, root, component_id), sum a hash of the text, root the component's smallest fingerprint."""
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sum"), F.col(text_col).alias("text"))
    rows = checkpointed(with_fingerprint(slim, "fp", shingle=shingle, keep=["id", "sum"]))
    found = checkpointed(groups(rows, "id"))
    # A fingerprint of more than one row in FEW is broadcast to its rows, so that its copies do not meet in one task.
    often = found.filter(F.col("copies") * FEW > rows.count())
    hot = rows.join(F.broadcast(often), "fp")
    rest = rows.join(F.broadcast(often.select("fp")), "fp", "left_anti").join(found, "fp")
    return hot.unionByName(rest).select("id", "sum", "fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is their component's, one for each component, all columns as they were.

    Rows of a component that share the id are told apart by a hash of their texts, then of all columns; one of them
    stays. An id on rows of several components is kept once in each whose smallest it is. A row with a null id can't be named: if no row of its component has an id, one row for each of its texts stays.
    Texts are shuffled once, to the join that picks rows; only rows whose id is repeated are ranked after it.
    """
    near = _near(docs, id_col, text_col, 3)
    own = near.filter(F.col("id").eqNullSafe(F.col("component_id")))
    unnamed = F.when(F.col("id").isNull(), F.col("sum"))
    stays = checkpointed(own.groupBy("id", "root", unnamed.alias("text")).agg(F.min("sum").alias("sum"), F.count("*").alias("rows")).drop("root", "text"))
    rank, total = free_name(docs, "rank"), free_name(docs, "sum")

    def kept(which: Column) -> DataFrame:
        d, k = docs.withColumn(total, F.xxhash64(text_col)).alias("d"), stays.filter(which).alias("k")
        at = F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.id")) & (F.col(f"d.{total}") == F.col("k.sum"))
        return d.join(k, at).select(*[F.col(f"d.`{c}`") for c in docs.columns])

    same = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    one_row, more = F.col("rows") == 1, F.col("rows") > 1
    return kept(one_row).unionAll(kept(more).withColumn(rank, F.row_number().over(same)).filter(F.col(rank) == 1).drop(rank))


def op3(docs: DataFrame) -> DataFrame:
    """Contract columns of the near-duplicate query."""
    near = near_duplicates(docs.select("doc_id", "text"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
