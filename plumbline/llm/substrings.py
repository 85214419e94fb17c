"""Repeated passages: seed on winnowed anchors, extend both ways, keep matches over the length threshold.

A text's words are hashed, and every run of K words; of each W = length - K + 1 consecutive runs the least is an
anchor (the last of equal ones). Two equal passages of `length` words pick the same anchor at the same place, so
joining documents on anchors loses nothing. An anchor that occurs once is dropped.

The K words of an anchor, the W - 1 before and the W - 1 after, cut at the text's ends, are its reach: as far as a
match has to be extended, since what lies beyond holds an anchor of its own. Anchors whose whole reach is equal
elsewhere match over all of it, and one of them stands for the class. Classes that share an anchor are joined on it
and each match is extended to the left and to the right, word against word; it is kept if it has `length` words.
An anchor of more than CLOSE classes is not compared pair by pair: its classes are joined on longer seeds, each of
the W runs of `length` words round the anchor. The longest extensions of an anchor to both sides are one span of its
text, and a text loses the union of its spans. No pairs of documents are made.

Hashes of words only propose: they choose anchors and bring rows together. What is removed was compared letter by
letter when a match was extended, or has the same 128-bit BLAKE2 digest of its letters where whole reaches and
whole windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from plumbline.llm.common import checkpointed, free_name, sliced, utf8

K = 8
#: Up to so many classes of one anchor are compared pair by pair.
CLOSE = 32
#: Reaches of more than one row in FEW are broadcast to their rows; windows of so many are dealt to SPREAD tasks each.
FEW, SPREAD = 5000, 64
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}
#: Longer words travel as a digest of their letters behind a byte that no word has.
LONG = 64
WORD_HASH = xxhash.xxh3_64_intdigest


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = held = np.multiply.accumulate(steps)
    return held[:n]


UPPER, LOWER = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair: the same for equal runs at any place."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=total[1:])
    lengths = (end - start).astype(np.uint64)
    return mixed((total[end] - total[start]) * powers(INVERSE, n + 1)[start] + lengths * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH, words), np.uint64, len(words))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def digests(parts: list[bytes]) -> np.ndarray:
    """Two longs for each of some byte strings."""
    return np.frombuffer(b"".join(map(digest, parts)), np.int64).reshape(-1, 2)


def anchors(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and run hashes of a text's anchors; none if it has fewer than `length` words."""
    if len(words) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(len(words) - K + 1)
    h = runs(words, at, at + K)
    # Upper halves of the hashes are compared; the lower halves hold places, so that the last of equal ones is least.
    low = (h & UPPER) | (LOWER - at.astype(np.uint64))
    width, wanted = 1, length - K + 1
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wanted:
        low = np.minimum(low[: width - wanted], low[wanted - width :])
    place = (LOWER - (low & LOWER)).astype(np.int64)
    place = np.unique(place)
    return place, h[place]


def _reaches(words: list[bytes], at: np.ndarray, length: int) -> np.ndarray:
    """Digests of the letters of each anchor's reach and of how much of it lies left."""
    side = length - K
    return digests([b"%d " % min(p, side) + b" ".join(words[max(p - side, 0) : p + length]) for p in at.tolist()])


def _concat(parts: list[np.ndarray], kind: type) -> pa.Array:
    return pa.array(np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind))


def _seeds(length: int):
    """(id, sum, text) to a row for each anchor."""

    def run(batches):
        for part in sliced(batches, "text"):
            found = []
            for text in utf8(part, "text"):
                words = text.split()
                at, seed = anchors(word_hashes(words), length)
                reach = _reaches(words, at, length)
                found.append((at, seed.view(np.int64), reach[:, 0], reach[:, 1]))
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            at, *keys = (_concat([x[k] for x in found], t) for k, t in enumerate((np.int32, np.int64, np.int64, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *keys, at], names=["id", "sum", "seed", "reach", "rest", "at"])

    return run


CONTEXT = "seed long, few boolean, id long, sum long, at int, left int, right int, words binary"


def _told(word: bytes) -> bytes:
    return word if len(word) <= LONG else b"\t" + digest(word).hex().encode()


def _contexts(length: int):
    """(id, sum, text, open) to a row for each open anchor of a text.

    words: those of the anchor's reach, joined by spaces. left and right: how many of them lie before and behind the
    anchor. Equal rows that follow each other count once.
    """
    side = length - K

    def run(batches):
        before = None
        for part in sliced(batches, "text"):
            keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            counts = part.column(3).value_lengths().to_numpy()
            at_all, seed, few = part.column(3).flatten().flatten()
            place = at_all.to_numpy()
            end = 0
            for i, text in enumerate(utf8(part, "text")):
                begin, end = end, end + counts[i]
                if keys[i] == before:
                    continue
                before = keys[i]
                words = [_told(w) for w in text.split()]
                for low in range(begin, end, 1 << 13):
                    at = place[low : min(low + (1 << 13), end)]
                    n = len(at)
                    body = pa.array([b" ".join(words[max(p - side, 0) : p + length]) for p in at.tolist()], pa.binary())
                    sides = [pa.array(np.minimum(x, side).astype(np.int32)) for x in (at, len(words) - at - K)]
                    owner = pa.array(np.full(n, i))
                    columns = [seed.slice(low, n), few.slice(low, n), part.column(0).take(owner), part.column(1).take(owner), at_all.slice(low, n), *sides, body]
                    yield pa.RecordBatch.from_arrays(columns, names=["seed", "few", "id", "sum", "at", "left", "right", "words"])

    return run


def _numbers(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _words(rows: pa.Table | pa.RecordBatch, side: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's anchor words, and numbers of the words round it, nearest first; equal words, equal numbers."""
    known: dict[bytes, int] = {}
    number = lambda word: known.setdefault(word, len(known))
    core, out = np.zeros(rows.num_rows, np.int64), np.full((rows.num_rows, 2 * side), -1, np.int64)
    for k, (line, left) in enumerate(zip(rows.column("words").to_pylist(), _numbers(rows, "left").tolist())):
        words = line.split(b" ")
        core[k] = number(b" ".join(words[left : left + K]))
        out[k, :left] = [number(w) for w in words[left - 1 :: -1]] if left else []
        after = words[left + K :]
        out[k, side : side + len(after)] = [number(w) for w in after]
    return core, out


def _agree(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words two rows have in common from the anchor outwards."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def extended(seed: np.ndarray, core: np.ndarray, left: np.ndarray, right: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest extensions to both sides over all long enough matches of each row; -1 where it has none.

    Rows of one seed are side by side, and only those of one core match; a match of l words to the left and r to the right is long enough if l + r is
    at least half the width of `words`.
    """
    side = words.shape[1] // 2
    far_left, far_right = np.full(len(seed), -1), np.full(len(seed), -1)
    for apart in range(1, len(seed)):
        i = np.flatnonzero(seed[apart:] == seed[:-apart])
        if not len(i):
            break
        i = i[core[i] == core[i + apart]]
        j = i + apart
        to_left = _agree(words[i, :side], words[j, :side], np.minimum(left[i], left[j]))
        to_right = _agree(words[i, side:], words[j, side:], np.minimum(right[i], right[j]))
        long_enough = to_left + to_right >= side
        for k in (i[long_enough], j[long_enough]):
            far_left[k] = np.maximum(far_left[k], to_left[long_enough])
            far_right[k] = np.maximum(far_right[k], to_right[long_enough])
    return far_left, far_right


def _reached(rows: pa.Table, side: int) -> tuple[np.ndarray, ...]:
    core, words = _words(rows, side)
    return core, _numbers(rows, "left"), _numbers(rows, "right"), words


def _whole_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows, cut between seeds only, equal anchors once."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        seed, total, at = (_numbers(rows, c) for c in ("seed", "sum", "at"))
        new = np.concatenate(([True], (seed[1:] != seed[:-1]) | (total[1:] != total[:-1]) | (at[1:] != at[:-1])))
        rows, seed = rows.filter(pa.array(new)), seed[new]
        start = int(np.searchsorted(seed, seed[-1])) if len(seed) else 0
        if start:
            yield rows.slice(0, start)
        held = rows.slice(start)
    if held is not None and held.num_rows:
        yield held


def _matched(length: int):
    """Context rows sorted by seed, sum and at to the spans of those that match."""
    side = length - K

    def run(batches):
        for rows in _whole_seeds(b for b in batches if b.num_rows):
            far_left, far_right = extended(_numbers(rows, "seed"), *_reached(rows, side))
            k = np.flatnonzero(far_left >= 0)
            at, own = _numbers(rows, "at")[k], rows.select(["id", "sum"]).take(pa.array(k)).combine_chunks()
            ends = [pa.array(x.astype(np.int32)) for x in (at - far_left[k], at + K + far_right[k])]
            yield from pa.Table.from_arrays([own.column(0), own.column(1), *ends], names=["id", "sum", "first", "last"]).to_batches()

    return run


def _longer_seeds(length: int):
    """Context rows to a row for each run of `length` words round the anchor: its digest, and the words before the anchor."""
    side = length - K

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 12):
                rows = batch.slice(low, 1 << 12)
                row, before, windows = [], [], []
                for k, (line, left, right) in enumerate(zip(rows.column("words").to_pylist(), _numbers(rows, "left").tolist(), _numbers(rows, "right").tolist())):
                    words = line.split(b" ")
                    some = range(max(side - right, 0), left + 1)
                    row += [k] * len(some)
                    before += some
                    windows += [b"%d " % b + b" ".join(words[left - b : left - b + length]) for b in some]  # of this anchor, not of another in it
                own = rows.select(["id", "sum", "at"]).take(pa.array(row, pa.int64()))
                key = digests(windows)
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), *own.columns, pa.array(before, pa.int32())], names=["window", "rest", "id", "sum", "at", "before"])

    return run


def cut(text: bytes, spans: list[dict[str, int]]) -> tuple[int, list[tuple[int, int]], bytes]:
    """Number of words, removed [first, last) word ranges - the union of `spans`, cut at the text's ends - and what is kept."""
    words = text.split()
    n = len(words)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.array([max(s["first"], 0) for s in spans], np.int64), 1)
    np.add.at(edge, np.array([min(s["last"], n) for s in spans], np.int64), -1)
    gone = np.concatenate(([False], np.cumsum(edge[:n]) > 0, [False]))
    turns = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
    merged = list(zip(turns[::2], turns[1::2]))
    kept, at = [], 0
    for a, b in merged:
        kept += words[at:a]
        at = b
    return n, merged, b" ".join(kept + words[at:])


def _cuts(keep: list[str]):
    def run(batches):
        for part in sliced(batches, "text"):
            done = [cut(t, s or []) for t, s in zip(utf8(part, "text"), part.column(1).to_pylist())]
            spans = [[{"first": a, "last": b} for a, b in s] for _, s, _ in done]
            made = [pa.array([n for n, _, _ in done], pa.int64()), pa.array([sum(b - a for a, b in s) for _, s, _ in done], pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array([k for _, _, k in done], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(part.columns[2:] + made, names=[*keep, "n_words", "n_removed", "removed", "kept"])

    return run


def _among(rows: DataFrame, kept: DataFrame, key: list[str], total: int) -> DataFrame:
    """`rows` whose key is in `kept`, whose n says how often; keys of more than one row in FEW are broadcast to them."""
    often = F.broadcast(kept.filter(F.col("n") * FEW > total).select(*key))
    others = rows.join(often, key, "left_anti").join(kept.select(*key), key, "left_semi")
    return rows.join(often, key, "left_semi").unionByName(others)


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """From (id, sum, text), sum a hash of the text: for each row that has repeats, their `spans` as for cut()."""
    found = checkpointed(docs.mapInArrow(_seeds(length), "id long, sum long, seed long, reach long, rest long, at int"))
    again = checkpointed(found.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1"))
    total = found.count()
    seeds = checkpointed(_among(found, again, ["seed"], total))  # an anchor that occurs once is seen no more
    key = ["seed", "reach", "rest"]
    reaches = checkpointed(seeds.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("id", "sum", "at")).alias("one")))
    classes = reaches.join(reaches.groupBy("seed").agg(F.count("*").alias("kinds")), "seed")
    classes = checkpointed(classes.select(*key, "n", "kinds", "one"))
    again = _among(seeds, classes.filter("n > 1").select(*key, "n"), key, total)
    # Each kind of match is written by itself, so that the shuffle files of one are gone before the next one's are made.
    whole = checkpointed(again.select("id", "sum", (F.col("at") - (length - K)).alias("first"), (F.col("at") + length).alias("last")))

    anchor = F.struct("one.at", "seed", (F.col("kinds") <= CLOSE).alias("few"))
    open_ = classes.filter("kinds > 1").groupBy("one.id", "one.sum").agg(F.collect_list(anchor).alias("open"))
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.sum") == F.col(f"{b}.sum"))
    texts = docs.alias("d").join(open_.alias("o"), same("d", "o")).select("d.id", "d.sum", "d.text", "o.open")
    contexts = checkpointed(texts.mapInArrow(_contexts(length), CONTEXT))
    close = contexts.filter("few").repartition("seed").sortWithinPartitions("seed", "sum", "at")
    matched = checkpointed(close.mapInArrow(_matched(length), "id long, sum long, first int, last int"))

    windows = contexts.filter("not few").mapInArrow(_longer_seeds(length), "window long, rest long, id long, sum long, at int, before int")
    again = windows.groupBy("window", "rest").count().filter("count > 1")
    hot = F.col("count") * FEW > contexts.count()  # at most FEW windows for each place in a reach
    spread = F.broadcast(again.filter(hot).select("window", "rest", F.lit(SPREAD).alias("spread")))
    dealt = windows.join(spread, ["window", "rest"], "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "sum", "at"), "spread"), F.lit(0)))
    again = again.select("window", "rest", F.explode(F.sequence(F.lit(0), F.when(hot, SPREAD - 1).otherwise(0))).alias("part"))
    first = F.col("at") - F.col("before")
    joined = dealt.join(again, ["window", "rest", "part"], "left_semi").groupBy("id", "sum", "at").agg(F.min(first).alias("first"), (F.max(first) + length).alias("last")).drop("at")
    spans = whole.union(matched).union(checkpointed(joined))
    return checkpointed(spans.groupBy("id", "sum").agg(F.collect_set(F.struct("first", "last")).alias("spans")))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` (None: all) plus n_words, n_removed, removed (word ranges), kept (the text that stays).

    A word goes if a window of `length` words that covers it also starts anywhere else, in the same row or another.
    Null, empty and short texts lose nothing; a null text has no words. Rows may share ids, texts or both; rows that
    are equal in both lose the same words. No rows give no rows. Columns of `docs` named like an output column are
    replaced. kept joins words by one space.
    """
    names = ("n_words", "n_removed", "removed", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("sum"), text.alias("text"))
    marks = repeats(slim, length)
    ident, total, body = (free_name(docs, k) for k in ("id", "sum", "text"))
    d = docs.withColumns({ident: F.col(id_col).cast("long"), total: F.xxhash64(text), body: text}).alias("d")
    joined = d.join(marks.alias("m"), F.col(f"d.{ident}").eqNullSafe(F.col("m.id")) & (F.col(f"d.{total}") == F.col("m.sum")), "left")
    ready = joined.select(F.col(f"d.{body}").alias("text"), "m.spans", *[F.col(f"d.`{c}`").alias(f"_{k}") for k, c in enumerate(keep)])
    fields = [StructField(c, docs.schema[c].dataType) for c in keep]
    span = StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])
    made = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(span)), StructField("kept", StringType())]
    return ready.mapInArrow(_cuts(keep), StructType(fields + made))


def op5(docs: DataFrame) -> DataFrame:
    """Contract columns of the passage query."""
    out = without_repeats(docs.select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
