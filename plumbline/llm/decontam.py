"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the benchmark items' ten-word windows in normal form (lower case, words between single spaces). They
are grouped by length; each group has a shift table over blocks of up to eight bytes, which says how far a cursor
may jump, and buckets of patterns by the hash of the block that ends their first m bytes, m being the group's
shortest length. A text is searched by many cursors at once, one for each stretch of it; a cursor whose shift is 0
looks into its bucket, and a direct comparison with the text confirms an occurrence.

Patterns are broadcast in blocks of bounded rows and bytes. A task builds the tables of a block once and holds them
all; a benchmark of more than `resident` blocks is searched in passes over the documents, each with so many blocks,
and what a pass finds is written beside the rows. So memory is bounded and the benchmark may be of any size.
Documents are not shuffled.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from plumbline.llm.common import checkpointed, free_name, sliced, table, utf8

WINDOW = 10
#: A pattern is a word of [0-9a-z\x80-\xff]+; A-Z are lower-cased and all other bytes separate words.
NORMAL = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))
STRETCH = 2048
RANGES = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MADE = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()), StructField("contaminated", BooleanType())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(text: bytes, n: int = WINDOW) -> set[bytes]:
    """The distinct windows of an item as b" w1 w2 ... wn "; an item of fewer words is one window."""
    w = words_of(text)
    return {b" " + b" ".join(w[i : i + n]) + b" " for i in range(max(1, len(w) - n + 1))} if w else set()


class Group:
    """Patterns of similar length with their shift table and suffix buckets."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, max(1, m // 3))
        self.mask = np.uint64((1 << (8 * b)) - 1)
        bits = min(22, max(12, math.ceil(math.log2(8 * len(patterns) * (m - b + 1)))))
        self.down = np.uint64(64 - bits)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m).astype(np.uint64)
        self.shift = np.full(1 << bits, m - b + 1, np.int32)
        for end in range(b, m + 1):
            value = sum((heads[:, end - b + i] << np.uint64(8 * i) for i in range(b)), np.zeros(len(patterns), np.uint64))
            slot = (value * SPREAD) >> self.down
            np.minimum.at(self.shift, slot, m - end)
        order = np.argsort(slot, kind="stable")
        self.buckets: dict[int, list[int]] = {}
        for k in order:
            self.buckets.setdefault(int(slot[k]), []).append(int(k))

    def search(self, text: bytes, size: int) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence in text[:size]; text has eight more bytes."""
        if size < self.m:
            return []
        eight = np.ndarray((size + 1,), "<u8", text, strides=(1,))
        at = np.arange(self.m, size + 1, STRETCH)
        stop = np.minimum(at + STRETCH, size + 1)
        ends, slots = [], []
        while len(at):
            slot = ((eight[at - self.block] & self.mask) * SPREAD) >> self.down
            jump = self.shift[slot]
            if not jump.all():
                zero = jump == 0
                ends.append(at[zero])
                slots.append(slot[zero])
            at = at + np.maximum(jump, 1)
            if not (live := at < stop).all():
                at, stop = at[live], stop[live]
        found = []
        for end, slot in zip(np.concatenate(ends).tolist(), np.concatenate(slots).tolist()) if ends else ():
            for k in self.buckets.get(slot, ()):
                if text.startswith(self.patterns[k], end - self.m):
                    found.append((end - self.m, k))
        return found


class Block:
    """A bounded block of (pattern, item) pairs."""

    LENGTHS = (0, 8, 16, 32, 1 << 62)

    def __init__(self, pairs: list[tuple[bytes, str]]):
        self.items: dict[bytes, list[str]] = {}
        for pattern, item in pairs:
            self.items.setdefault(pattern, []).append(item)
        parts = [[p for p in self.items if low <= len(p) < high] for low, high in zip(self.LENGTHS, self.LENGTHS[1:])]
        self.groups = [Group(p) for p in parts if p]

    def hits(self, texts: list[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text: the [first, last) word ranges that are hit, and the items whose windows occur."""
        whole = b"\n".join(b" " + b" ".join(w) + b" " if w else b"" for w in texts)
        size, out = len(whole), {}
        padded = whole + bytes(8)
        found = [(start, g.patterns[k]) for g in self.groups for start, k in g.search(padded, size)]
        if found:
            data = np.frombuffer(whole, np.uint8)
            breaks = np.flatnonzero(data == 10)
            spaces = np.flatnonzero(data == 32)
            first = np.searchsorted(spaces, np.concatenate(([0], breaks + 1)))
            start = np.array([s for s, _ in found])
            doc = np.searchsorted(breaks, start)
            word = np.searchsorted(spaces, start) - first[doc]
            for d, w, (_, pattern) in zip(doc.tolist(), word.tolist(), found):
                ranges, items = out.setdefault(d, ([], set()))
                ranges.append((w, w + pattern.count(b" ") - 1))
                items.update(self.items[pattern])
        return out


def covered(ranges: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


FOUND = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _searched(docs: DataFrame, blocks: list, keep: list[str], text_col: str, before: list[str], after: list[str] | None) -> DataFrame:
    """Columns `keep` plus what is found: ranges and items as columns named `after`, or the last columns if None.

    before: names of the columns with what earlier passes found; none in the first.
    """
    made = MADE if after is None else StructType([StructField(after[0], RANGES), StructField(after[1], ArrayType(StringType()))])
    schema = StructType([docs.schema[c] for c in keep] + list(made.fields))
    wanted = list(dict.fromkeys([*keep, text_col, *before]))

    def run(batches):
        held = [Block(pickle.loads(b.value)) for b in blocks]
        for part in sliced(batches, text_col):
            column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            words = [words_of(t) for t in utf8(part, text_col)]
            ranges = [[(r["first"], r["last"]) for r in x] for x in column(before[0]).to_pylist()] if before else [[] for _ in words]
            items = [set(x) for x in column(before[1]).to_pylist()] if before else [set() for _ in words]
            for block in held:
                for d, (r, i) in block.hits(words).items():
                    ranges[d] += r
                    items[d] |= i
            if after is None:
                n_hit = [covered(r) for r in ranges]
                sha = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
                new = [pa.array([len(w) for w in words], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(sha, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
            else:
                new = [pa.array([[{"first": a, "last": b} for a, b in r] for r in ranges], FOUND), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([column(c) for c in keep] + new, names=[*keep, *made.names])

    return docs.select(*[docs[c] for c in wanted]).mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, block_rows: int = 200_000, block_bytes: int = 32 << 20, resident: int = 4) -> DataFrame:
    """Columns `keep` of `docs` (None: all) plus n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and no hits; null and wordless items match nothing; an item id that is
    null reads "null". Repeated items count once. Empty tables give no hits or no rows. Columns of `docs` named like
    an output column are replaced. block_rows, block_bytes: bounds of a broadcast block of patterns. resident: blocks
    that a task holds at once; with the defaults some 600 MB of tables at most.
    """
    made = StructType([StructField("pattern", StringType())])
    spark = docs.sparkSession
    texts = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))

    def windows(batches):
        for batch in batches:
            pairs = [(w.decode(), i) for t, i in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()) for w in windows_of((t or "").encode())]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([i for _, i in pairs], pa.string())], names=["pattern", "item"])

    pairs = checkpointed(texts.mapInArrow(windows, StructType([*made.fields, StructField("item", StringType())])).distinct())
    n, size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    count = max(math.ceil(n / block_rows), math.ceil(size / block_bytes))
    names = set(MADE.names)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    found: list[str] = []
    for start in range(0, max(count, 1), resident):
        blocks = []
        for k in range(start, min(start + resident, count)):
            rows = pairs.filter(F.pmod(F.xxhash64("pattern", "item"), F.lit(count)) == k).collect()
            blocks.append(spark.sparkContext.broadcast(pickle.dumps(sorted((r["pattern"].encode(), r["item"]) for r in rows))))
        if start + resident >= count:
            return _searched(docs, blocks, keep, text_col, found, None)
        after = [free_name(docs, f"ranges{start}"), free_name(docs, f"items{start}")]
        held = list(dict.fromkeys([*keep, text_col]))
        docs, found = checkpointed(_searched(docs, blocks, held, text_col, found, after)), after
        for b in blocks:
            b.unpersist()


def op10(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the decontamination query."""
    return decontaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
