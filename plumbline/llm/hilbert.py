"""Sharding along a Hilbert curve over quantised metadata, in DataFrame functions only.

Rows are ordered by the Hilbert index of (source, lang, size, id), each quantised to 2**bits equi-depth levels,
and the order is cut into runs of equal row counts. Neighbours on the curve are neighbours in every dimension,
so a shard's files have narrow min/max ranges in all of them and a reader prunes on any of them.

Levels are equi-depth over whole values: a value's level is the share of rows below it. For names (source, lang) the
rows below come from counts by value, for numbers from histograms that are refined where a level begins. Only
bounded things reach the driver or one task: a value for each level, histograms of 4096 bins, and the counts of at
most 2**(4 * bits) cells. Rows are numbered inside (cell, hash split) groups; the number of splits grows with the row
count, so that a cell with a third of all rows is numbered by many tasks, and rows that are equal in great numbers
are spread over splits of their own.
"""

from __future__ import annotations

import math
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, free_name

BINS = 4096
DIMS = 4
#: Tables of at most so many different names are ordered in one task; larger ones in ranges.
FEW_NAMES = 100_000
#: More rows than this that are equal in id, text and size are spread by number, not by hash.
EQUAL = 1 << 20


@cache
def transitions(dims: int = DIMS) -> list[int]:
    """Hilbert state machine: entry state * 2**dims + cell digit holds next state * 2**dims + curve digit.

    A state is an entry corner and an axis; a curve digit is the Gray rank of the cell digit after it is turned
    into the state's frame.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    out = []
    for corner in range(size):
        for axis in range(dims):
            for digit in range(size):
                w = rank[turn(digit ^ corner, -(axis + 1))]
                entry = 0 if w == 0 else gray[2 * ((w - 1) // 2)]
                step = 0 if w == 0 else (((~w & (w + 1)) if w % 2 else (~(w - 1) & w)).bit_length() - 1)
                to = (corner ^ turn(entry, axis + 1)) * dims + (axis + step + 1) % dims
                out.append(to * size + w)
    return out


def curve_index(levels: list[Column], bits: int) -> Column:
    """Index on the curve of a cell with the given coordinates, the first level being the most significant."""
    size, machine = 1 << len(levels), F.lit(transitions(len(levels)))

    def step(done: Column, bit: Column) -> Column:
        digit = reduce(lambda a, c: a * 2 + F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1)), levels, F.lit(0))
        at = F.get(machine, F.shiftright(done["at"], len(levels)) * size + digit)
        return F.struct(at.alias("at"), (done["out"] * size + at.bitwiseAND(F.lit(size - 1))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("out"))
    return F.aggregate(F.lit(list(reversed(range(bits)))), start, step)["out"]


def _first_names(df: DataFrame, name: str, levels: int, total: int) -> list[str]:
    """The least value of each level but the lowest; null is below all values."""
    counts = checkpointed(df.groupBy(name).agg(F.count("*").alias("n")).filter(F.col(name).isNotNull()))
    nulls = F.lit(total) - F.sum("n")
    rows, missing = counts.agg(F.count("*"), F.coalesce(nulls, F.lit(total))).first()
    if rows > FEW_NAMES:
        counts = checkpointed(counts.repartitionByRange(256, name).withColumn("range", F.spark_partition_id()))
        heads = counts.groupBy("range").agg(F.sum("n").alias("s")).select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("h"))
        placed = counts.join(F.broadcast(heads), "range")  # 256 rows
        below = F.sum("n").over(Window.partitionBy("range").orderBy(name)) - F.col("n") + F.col("h")
    else:
        placed, below = counts, F.sum("n").over(Window.orderBy(name)) - F.col("n")
    level = F.floor((below + missing) * levels / max(total, 1))
    first = placed.select(F.col(name).alias("value"), level.alias("level")).groupBy("level").agg(F.min("value").alias("value")).filter("level > 0")
    return [r["value"] for r in first.orderBy("level").collect()]


def _first_numbers(df: DataFrame, name: str, levels: int, total: int, low: int, high: int) -> list[int]:
    """The least long of each level but the lowest, to a bin that holds few rows or one value; null is below all."""
    wide = 16 * levels
    parts = {0: (low, high)}  # ranges that are looked into, and the rows below each
    below = {0: None}
    found: dict[int, int] = {}
    for _ in range(8):
        cases, spans = F.lit(None).cast("string"), {}
        for k, (a, b) in parts.items():
            step = max(1, -(-(b - a + 1) // BINS))
            spans[k] = (a, step)
            code = F.concat_ws(":", F.lit(k), F.expr(f"(cast(`{name}` as decimal(38,0)) - ({a})) div {step}"))
            cases = F.when((F.col(name) >= a) & (F.col(name) <= b), code).otherwise(cases)
        counts = {r["code"]: r["n"] for r in df.select(cases.alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}
        more, ahead = {}, {}
        for k, (a, step) in spans.items():
            seen = below[k] if below[k] is not None else counts.get(None, 0)
            bins = sorted((int(c.split(":")[1]), n) for c, n in counts.items() if c is not None and c.startswith(f"{k}:"))
            for i, n in bins:
                at, then = seen * levels // total, (seen + n) * levels // total
                start = a + i * step
                if at and (at not in found or start < found[at]):
                    found[at] = start
                if then > at and step > 1 and n * wide > total:
                    more[len(more)] = (start, start + step - 1)
                    ahead[len(ahead)] = seen
                seen += n
        parts, below = more, ahead
        if not parts:
            break
    return [found[k] for k in sorted(found)]


def _level(firsts: list, value: Column) -> Column:
    """Number of levels that begin at or below a value; 0 for null."""
    return F.coalesce(F.size(F.filter(F.lit(firsts), lambda v: v <= value)), F.lit(0)) if firsts else F.lit(0)


def hilbert_shards(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", bits: int = 3, equal: int = EQUAL) -> DataFrame:
    """All rows and columns of `docs` plus size, text_crc32, shard, slot (law `rows`).

    size: UTF-8 bytes of the text (null: 0) plus 8. Shard counts are at most one apart; slots are gapless from 0.
    Null ids, sources and languages sort before all others; a null text counts as empty. Repeated rows get a slot
    each; more than `equal` of them are written once and numbered there. An empty table gives an empty result. Columns of `docs` named like an output column are replaced.
    """
    docs = docs.drop(*(c for c in ("size", "text_crc32", "shard", "slot") if c in docs.columns))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumns({"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    cell, split, tie, ahead, rank, group, *work = (free_name(sized, k) for k in ("cell", "split", "tie", "ahead", "rank", "group", *(f"level{d}" for d in range(DIMS))))
    of = {"source": F.col(source_col).cast("string"), "lang": F.col(lang_col).cast("string"), "size": F.col("size"), "id": F.col(id_col).cast("long")}
    slim = checkpointed(sized.select(*[c.alias(k) for k, c in of.items()], F.xxhash64(F.col(id_col), F.col("text_crc32"), F.col("size")).alias("tie")))
    b = slim.agg(F.count("*").alias("n"), *(f(k).alias(f"{k}_{n}") for k in ("size", "id") for n, f in (("low", F.min), ("high", F.max)))).first()
    total, depth = b["n"], 2**bits
    firsts = {k: _first_names(slim.select(k), k, depth, total) for k in ("source", "lang")}
    firsts |= {k: _first_numbers(slim.select(k), k, depth, total, b[f"{k}_low"], b[f"{k}_high"]) if b[f"{k}_low"] is not None else [] for k in ("size", "id")}
    splits = max(256, math.ceil(total / 2**20))

    def placed(rows: DataFrame, columns: dict[str, Column], key: Column) -> DataFrame:
        """`rows` plus cell, tie and split."""
        out = rows.withColumns({w: _level(firsts[k], c) for w, (k, c) in zip(work, columns.items())})
        return out.withColumns({cell: curve_index([F.col(c) for c in work], bits), tie: key}).drop(*work).withColumn(split, F.pmod(F.col(tie), F.lit(splits)))

    keyed = placed(sized, of, F.xxhash64(F.col(id_col), F.col("text_crc32"), F.col("size")))
    light = placed(slim, {k: F.col(k) for k in of}, F.col("tie")).select(cell, split, tie)
    counts = checkpointed(light.groupBy(cell, split).agg(F.count("*").alias("n")))
    full = [r[split] for r in counts.filter(F.col("n") > equal).select(split).distinct().collect()]  # at most rows / equal
    ties = light.filter(F.col(split).isin(full)).groupBy(tie).agg(F.count("*").alias("n")).filter(F.col("n") > equal) if full else None
    ties = checkpointed(ties.select(F.col(tie).alias(group))) if full else None
    if full and ties.count():
        same, few = F.col(tie) == F.col(group), F.broadcast(ties)  # at most rows / equal
        number = checkpointed(keyed.join(few, same, "left_semi")).withColumn(split, splits + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(splits)))
        keyed = keyed.join(few, same, "left_anti").unionAll(number)
        counts = checkpointed(light.join(few, same, "left_anti").select(cell, split).unionAll(number.select(cell, split)).groupBy(cell, split).agg(F.count("*").alias("n")))
    cells = counts.groupBy(cell).agg(F.sum("n").alias("n")).select(cell, (F.sum("n").over(Window.orderBy(cell)) - F.col("n")).alias("before"))
    inside = counts.select(cell, split, (F.sum("n").over(Window.partitionBy(cell).orderBy(split)) - F.col("n")).alias("within"))
    starts = inside.join(cells, cell).select(cell, split, (F.col("before") + F.col("within")).alias(ahead))
    order = Window.partitionBy(cell, split).orderBy(tie, id_col, "size", "text_crc32")
    ranked = keyed.join(starts, [cell, split]).withColumn(rank, F.col(ahead) + F.row_number().over(order) - 1)
    shard = F.expr(f"`{rank}` * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col(rank) - first).drop(cell, split, tie, ahead, rank)


def op7(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Contract columns of the sharding query."""
    out = hilbert_shards(docs.select("doc_id", "text", "source", "lang"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
