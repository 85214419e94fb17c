"""Source divergence audit: how far the word use of a language's sources lies apart, by inclusion-exclusion over supports.

A group is a (lang, source). With pseudo-counts every kept term of the language has a share p in every group, so a
pair's divergence is a sum over the whole vocabulary; but p depends only on the term's count and the
group's size, and is the constant z where the count is 0. For groups A and B the sum is therefore

    terms of A priced against z of B  +  terms of B priced against z of A
  + for terms of both: f(pA, pB) - f(pA, zB) - f(zA, pB) + f(zA, zB)
  + (V - |A| - |B|) * f(zA, zB)

The first line needs no terms at all: a histogram of each group's counts, priced once for each different z. The
second comes from a join of posting lists of the terms that two groups share. The third is a constant of the pair.
All numbers are integers. Counts are made in the tasks that read the texts and only their sums are shuffled, with
numbers for groups in place of their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, pieces, sliced, utf8

#: A-Z are lower-cased, other ASCII letters and all bytes of other characters stay, the rest of ASCII separates terms.
LETTERS = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32) for b in range(256))
SCALE = 1_000_000_000
#: Counters of a task are handed on when they have so many entries.
ENTRIES = 400_000
#: Tables of groups of at most so many rows and bytes are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: A larger table of groups goes to so many parts of the rows that it is joined to.
PARTS = 256
#: A term of more sources is joined in several parts of its posting list.
WIDE = 1000
COUNTS = "lid long, gid long, term string, n long, docs long"


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    """Counters to rows of COUNTS."""
    for (lid, gid), (n, docs) in held.items():
        groups = [pa.array(np.full(len(n), x)) for x in (lid, gid)]
        numbers = [pa.array(list(values), pa.int64()) for values in (n.values(), map(docs.__getitem__, n))]
        yield pa.RecordBatch.from_arrays([*groups, pa.array(list(n), pa.binary()).cast(pa.string()), *numbers], names=["lid", "gid", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], tuple[Counter, Counter]] = {}
    size = 0
    for part in sliced(batches, "text"):
        for lid, gid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part, "text")):
            n, docs = held.setdefault((lid, gid), (Counter(), Counter()))
            before, seen = len(n), set()
            for piece in pieces(text, LETTERS):
                words = piece.split()
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n) - before
        if size > ENTRIES:
            yield from _rows(held)
            held, size = {}, 0
    yield from _rows(held)


def _numbers(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), "lang").alias("lid"), F.xxhash64(F.lit(seed), "lang", "source").alias("gid")]


def _numbered(names: DataFrame) -> int:
    """A seed whose hashes tell all langs and all groups apart."""
    for seed in range(100):
        n, langs, lids, gids = names.select("*", *_numbers(seed)).agg(F.count("*"), F.count_distinct("lang"), F.count_distinct("lid"), F.count_distinct("gid")).first()
        if (n, langs) == (gids, lids):
            return seed
    raise ValueError("no seed tells the groups apart")


def share(count: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / size), in decimals until it is small."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, size.cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), p + q)


def _beside(many: DataFrame, groups: DataFrame, keys: list[str], small: bool, salt: Column) -> DataFrame:
    """Inner join on keys that a third of `many` may share: `groups` is broadcast if small, else copied to PARTS parts."""
    if small:
        return many.join(F.broadcast(groups), keys)
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(PARTS)).cast("int")).join(copies, [*keys, "_salt"]).drop("_salt")


def _overlaps(postings: DataFrame) -> DataFrame:
    """(a, b, both) for groups a < b with terms in common: what their shared terms change in the two one-sided sums."""
    parts = F.ceil(F.col("sources") / WIDE).cast("int")
    own = F.when(parts > 1, F.pmod(F.xxhash64("gid"), parts).cast("int")).otherwise(0)
    left = postings.select("tid", own.alias("part"), F.col("gid").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = postings.select("tid", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("gid").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    met = left.join(right, ["tid", "part"]).filter("a < b")
    pa_, pb, za, zb = map(F.col, ("pa", "pb", "za", "zb"))
    return met.groupBy("a", "b").agg(F.sum(gap(pa_, pb) - gap(pa_, zb) - gap(za, pb) + gap(za, zb)).alias("both"))


def _pairs(groups: DataFrame, postings: DataFrame, small: bool) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    histogram = postings.groupBy("lid", "gid", "p").agg(F.count("*").alias("terms"))
    sides = groups.filter("v > 0").select("lid", F.col("z").alias("side")).distinct()
    priced = _beside(histogram, sides, ["lid"], small, F.struct("gid", "p"))
    priced = checkpointed(priced.groupBy("gid", "side").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("side"))).alias("one")))
    names = ("gid", "source", "z", "terms")
    a = groups.select("lid", "lang", "v", *[F.col(c).alias(f"{c}_a") for c in names])
    b = groups.select("lid", *[F.col(c).alias(f"{c}_b") for c in names])
    pairs = _beside(a, b, ["lid"], small, F.col("gid_a")).filter("gid_a < gid_b")
    for x, y in ("ab", "ba"):
        one = priced.select(F.col("gid").alias(f"gid_{x}"), F.col("side").alias(f"z_{y}"), F.col("one").alias(f"one_{x}"))
        pairs = pairs.join(one, [f"gid_{x}", f"z_{y}"], "left")
    pairs = pairs.join(_overlaps(postings).withColumnsRenamed({"a": "gid_a", "b": "gid_b"}), ["gid_a", "gid_b"], "left")
    nowhere = (F.col("v") - F.col("terms_a") - F.col("terms_b")) * gap(F.col("z_a"), F.col("z_b"))
    value = sum((F.coalesce(c, F.lit(0)) for c in ("one_a", "one_b", "both")), nowhere)
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    return pairs.select("lang", F.when(F.col("v") > 0, value).otherwise(0).alias("value"), F.explode(both).alias("ends")).select("lang", "ends.source", "ends.item", "value")


def divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source by its distance, and the `top` terms that set a source apart.

    Null texts have no terms; null and empty langs and sources are one value, the empty text. A row is a document,
    repeated rows too. A language keeps terms that `least_docs` of its documents hold. A source alone in its language
    has no pairs; a language that keeps no term has pairs of value 0 and no terms. Ties are ranked by item, in order
    of UTF-8 bytes. Other columns of `docs` are not read. No rows give no rows.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.col(text_col).alias("text"))
    names = checkpointed(texts.select("lang", "source").distinct())
    numbers = _numbers(_numbered(names))
    sums = texts.select(*numbers, "text").mapInArrow(_counted, COUNTS).groupBy("lid", "gid", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = checkpointed(sums)
    terms = counts.groupBy("lid", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs"), F.count("*").alias("sources"))
    terms = checkpointed(terms.filter(F.col("docs") >= least_docs).drop("docs").withColumn("tid", F.monotonically_increasing_id()))
    kept = checkpointed(counts.drop("docs").join(terms, ["lid", "term"]))

    langs = terms.groupBy("lid").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_size"))
    sizes = kept.groupBy("gid").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    filled = names.select("*", *numbers).join(sizes, "gid", "left").join(langs, "lid", "left").fillna(0, ["size", "terms", "v", "lang_size"])
    z = F.when(F.col("v") > 0, share(F.lit(0), F.col("size") + 2 * F.col("v")))
    groups = checkpointed(filled.withColumn("z", z))
    n, size = groups.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source") + 64), F.lit(0))).first()
    small = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES

    p, q = share(F.col("n"), F.col("size") + 2 * F.col("v")), share(F.col("whole"), F.col("lang_size") + 2 * F.col("v"))
    postings = _beside(kept, groups.drop("lid", "lang", "source", "terms"), ["gid"], small, F.col("tid")).withColumns({"p": p, "q": q})
    pairs = _pairs(groups, postings, small).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    apart = postings.filter("p > q").select("gid", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    best = apart.withColumn("rank", rank("gid")).filter(F.col("rank") <= top)
    named = groups.select("gid", "lang", "source")
    best = best.join(F.broadcast(named) if small else named, "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", rank("lang", "source")).unionByName(best)


def op11(docs: DataFrame) -> DataFrame:
    """Contract columns of the divergence query."""
    return divergence(docs.select("text", "lang", "source"))
