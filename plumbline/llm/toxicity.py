"""Toxicity by nearest labelled examples: exact weighted TF-IDF cosine over a block-max inverted index.

Terms are words (lower case, ASCII punctuation apart) and their first five and seven letters. Every term of the
examples is in the index, and every term of a text counts in its norm. Document frequencies are those of the
examples, which are the model's whole corpus; a term that none has counts with frequency 0. A term's idf is
multiplied by the root of its chi-square with the label where that is above 1.

Examples with like terms stand together in blocks of 64. A rare term has a posting list; a term that many examples
have has a row of weights and the largest of each block. Texts are asked many at a time: the lists of their rare
terms are added up, block maxima of the others bound what a block can still reach, blocks are read from the highest
bound down, and a text is done when its next bound is below its k-th best cosine; so neighbours are exact.

Neighbours vote with weight 1 / (distance + c), distance being 1 - cosine; they are the evidence of a score. A
logistic curve turns votes into probabilities; it is fitted to votes on each fifth of the examples by the other
four, whose weights, frequencies and index have seen none of it. Bounds: at most about `most` labelled ids are learned
from, chosen by a hash of the id, with texts of at most `longest` bytes; whole texts of examples are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from plumbline.llm.common import checkpointed, sliced, utf8
from plumbline.llm.rows import with_computed

BLOCK = 64
#: A term of at least this share of the examples has a row of weights in place of a list.
OFTEN = 1 / 16
#: Blocks read for each text in the first step; each further step takes twice as many.
TOGETHER = 4
#: Texts that are asked together.
ASKED = 256
NEAREST = 15
#: Bytes of the longest text that is learned from.
LONGEST = 1 << 16
SOFT = 0.05
PREFIXES = (5, 7)
#: Parts of the examples that vote on each other for the calibration.
PARTS = 5
#: Bytes of text whose terms are counted together; arrays are about 20 times as large.
SLICE = 2 << 20
#: ASCII but letters and digits to spaces.
BLANK = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words of a UTF-8 text."""
    return text.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(BLANK).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word itself and its prefixes, marked by a star."""
    letters = word.decode("utf-8", "replace")
    return [word, *(letters[:n].encode() + b"*" for n in PREFIXES if len(letters) > n)]


class Words(dict):
    """A number for each word met, and the slots of the terms of each number."""

    def __init__(self, terms: Terms):
        self.terms, self.new = terms, []
        self.flat, self.end = np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(list(map(self.terms.one, terms_of(word))))
        return n

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """All slots one word after the other, and where each word's end."""
        if self.new:
            self.end = np.append(self.end, len(self.flat) + np.cumsum(list(map(len, self.new))))
            self.flat = np.append(self.flat, [s for own in self.new for s in own])
            self.new.clear()
        return self.flat, self.end


class Terms:
    """Counts of all terms of texts: slots of the vocabulary, then numbers of other terms; words are held for the next texts."""

    HELD = 300_000

    def __init__(self, vocabulary: list[bytes]):
        self.slot = {t: i for i, t in enumerate(vocabulary)}
        self._forget()

    def _forget(self) -> None:
        self.words, self.other = Words(self), {}

    def __getstate__(self):
        return {"slot": self.slot}

    def __setstate__(self, state):
        self.slot = state["slot"]
        self._forget()

    def one(self, term: bytes) -> int:
        s = self.slot.get(term)
        return len(self.slot) + self.other.setdefault(term, len(self.other)) if s is None else s

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, slot, count), in order of text and slot, for all different terms of each text."""
        if len(self.words) > self.HELD:
            self._forget()
        many, word = [], []
        for t in texts:
            w = words_of(t)
            many.append(len(w))
            word += w
        n = np.fromiter(map(self.words.__getitem__, word), np.int64, len(word))
        text, n, count = tally(np.repeat(np.arange(len(texts)), many), n, None, len(self.words))
        slots, end = self.words.arrays()
        at, each = spans(np.where(n > 0, end[n - 1], 0), end[n])
        return tally(np.repeat(text, each), slots[at], np.repeat(count, each), len(self.slot) + len(self.other))


def tally(text: np.ndarray, n: np.ndarray, count: np.ndarray | None, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs (text, n) in order, n being below `many`, with the sum of their counts, or how often they come."""
    key = text * max(many, 1) + n
    if count is None:
        key = np.sort(key)
    else:
        by = np.argsort(key)
        key, count = key[by], count[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.diff(np.append(first, len(key))) if count is None else np.add.reduceat(count, first) if len(first) else count
    text, n = np.divmod(key[first], max(many, 1))
    return text, n, total


def weights(text: np.ndarray, slot: np.ndarray, count: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """(1 + ln tf) * idf, each text at unit length; the last idf is that of all terms that no example has."""
    w = (1 + np.log(count)) * idf[np.minimum(slot, len(idf) - 1)]
    norm = np.sqrt(np.bincount(text, w * w, minlength=texts))
    return w / np.maximum(norm, 1e-300)[text]


def spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start up to its end, one after the other, and the length of each."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class Index:
    """Block-max inverted index over example vectors given as (text, slot, weight) in order of text and slot; slots are below `terms`."""

    def __init__(self, text: np.ndarray, slot: np.ndarray, w: np.ndarray, ids: np.ndarray, labels: np.ndarray, terms: int):
        self.n = n = len(ids)
        heavy = np.full((n, 3), terms)
        by = np.lexsort((slot, -w, text))
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        heavy[text[by][rank < 3], rank[rank < 3]] = slot[by][rank < 3]
        self.order = np.lexsort((np.arange(n), heavy[:, 2], heavy[:, 1], heavy[:, 0]))
        self.ids, self.labels = np.asarray(ids, np.int64)[self.order], np.asarray(labels, np.float64)[self.order]
        self.blocks = max(1, -(-n // BLOCK))
        place = np.argsort(self.order)[text]
        by = np.lexsort((place, slot))
        slot, place, w = slot[by], place[by], w[by]
        have = np.bincount(slot, minlength=terms)
        often = have >= max(2, n * OFTEN)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        in_row = often[slot]
        self.full = np.zeros((int(often.sum()), self.blocks * BLOCK))
        self.full[self.row[slot[in_row]], place[in_row]] = w[in_row]
        self.top = self.full.reshape(-1, self.blocks, BLOCK).max(axis=2)
        self.place, self.weight = place[~in_row], w[~in_row]
        self.first = np.append(0, np.cumsum(np.where(often, 0, have)))

    def nearest(self, text: np.ndarray, slot: np.ndarray, w: np.ndarray, texts: int, k: int = NEAREST, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, cosine) of the k nearest examples of each text, best first; ties go to the lower place.

        The texts' vectors are (text, slot, weight) in order of text. without: for each text a place to leave out.
        Cosines are rounded to nine digits, so that they do not depend on which texts are asked together.
        """
        known = slot < len(self.row)
        text, slot, w = text[known], slot[known], w[known]
        found = []
        for at in range(0, texts if self.n else 0, ASKED):
            a, b = np.searchsorted(text, (at, at + ASKED))
            some = min(ASKED, texts - at)
            t, p, c = self._nearest(text[a:b] - at, slot[a:b], w[a:b], some, k, None if without is None else without[at : at + some])
            found.append((t + at, p, c))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def _nearest(self, text, slot, w, texts, k, without):
        row = self.row[slot]
        in_row = row >= 0
        asked = np.zeros((texts, len(self.full)))
        asked[text[in_row], row[in_row]] = w[in_row]
        text, slot, w = text[~in_row], slot[~in_row], w[~in_row]
        posting, each = spans(self.first[slot], self.first[slot + 1])
        width = self.blocks * BLOCK
        sums = np.bincount(np.repeat(text, each) * width + self.place[posting], np.repeat(w, each) * self.weight[posting], minlength=texts * width)
        sums = sums.reshape(texts, self.blocks, BLOCK)
        bound = sums.max(axis=2) + asked @ self.top
        order = np.argsort(-bound, axis=1, kind="stable")
        highest = np.take_along_axis(bound, order, axis=1)
        cosine = np.zeros((texts, self.blocks, BLOCK))
        kth, at, step = np.zeros(texts), 0, TOGETHER
        live = np.arange(texts)
        full = self.full.reshape(-1, self.blocks, BLOCK)
        self.read = 0
        while len(live) and at < self.blocks:
            wanted = highest[live, at : at + step] >= np.maximum(kth[live] - 1e-9, 1e-9)[:, None]
            who, which = np.nonzero(wanted)
            block = order[live[who], at + which]
            self.read += len(block)
            by = np.argsort(block, kind="stable")
            edge = np.flatnonzero(np.diff(block[by], prepend=-1))
            for turn, x in zip(np.split(by, edge[1:]), block[by][edge]):
                some = live[who[turn]]
                cosine[some, x] = np.round(sums[some, x] + asked[some] @ full[:, x], 9)
            if without is not None:
                cosine.reshape(texts, -1)[np.arange(texts), without] = 0
            at, step = at + step, step * 2
            live = live[wanted.all(axis=1)]
            if len(live) and k < at * BLOCK < width:
                flat = cosine[live[:, None], order[live, :at]].reshape(len(live), -1)
                kth[live] = np.partition(flat, -k, axis=1)[:, -k]
        flat = cosine.reshape(texts, -1)
        t, p = np.nonzero(flat >= np.maximum(kth, 1e-9)[:, None])  # kth is of the blocks read before the last step
        c = flat[t, p]
        by = np.lexsort((p, -c, t))
        t, p, c = t[by], p[by], c[by]
        keep = np.arange(len(t)) - np.searchsorted(t, t) < k
        return t[keep], p[keep], np.minimum(c[keep], 1.0)

    def vote(self, text, slot, w, texts: int, prior: float, without: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Distance-weighted share of label 1 among the neighbours, the prior counting as one far neighbour; and these."""
        t, place, cosine = near = self.nearest(text, slot, w, texts, without=without)
        pull = 1 / (1 - cosine + SOFT)
        return (np.bincount(t, pull * self.labels[place], minlength=texts) + prior) / (np.bincount(t, pull, minlength=texts) + 1), near


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset by weighted Newton steps with a little ridge; the slope is not negative."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        off = w * (p - y)
        g = np.array([x @ off + 1e-3 * a, off.sum()])
        v = w * p * (1 - p) + 1e-9
        h = np.array([[v @ (x * x) + 1e-3, v @ x], [v @ x, v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def _log_odds(share: np.ndarray | float) -> np.ndarray:
    s = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(s / (1 - s))


def examples(docs: DataFrame, labels: DataFrame, may_learn: Column, most: int, longest: int = LONGEST) -> tuple[DataFrame, float]:
    """(id, text, toxic) of about `most` labelled ids at most, half of them of each label where there are enough.

    Ids whose only texts are null or of more than `longest` bytes are passed over. Also the share of label 1 among all ids that may be learned from. An id with several labels counts as toxic if
    one of them says so; of one with several texts the least is learned from.
    """
    known = labels.filter(may_learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    have = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("toxic") == 1, most / 2 / max(have.get(1, 0), 1)).otherwise(most / 2 / max(have.get(0, 0), 1))
    chosen = checkpointed(known.filter(draw < share).select(F.col("doc_id").alias("id"), "toxic"))
    small = F.broadcast(chosen) if chosen.count() <= 2 * most else chosen
    fit = docs.filter(F.octet_length("text") <= longest)
    rows = fit.select(F.col("doc_id").alias("id"), "text").join(small, "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    return rows.select("id", "text", "toxic"), have.get(1, 0) / max(sum(have.values()), 1)


def term_weights(text: np.ndarray, slot: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """idf of each term among labelled texts, times the root of its chi-square with the label, and of a term that none has."""
    n, n1 = len(y), y.sum()
    n0 = n - n1
    have = np.bincount(slot, minlength=terms).astype(np.float64)
    a = np.bincount(slot, y[text], minlength=terms)
    b = have - a
    apart = a * (n0 - b) - b * (n1 - a)
    chi = n * apart * apart / np.maximum(have * (n - have) * n1 * n0, 1.0)
    idf = (np.log((1 + n) / (1 + have)) + 1) * np.sqrt(np.maximum(chi, 1.0))
    return np.append(idf, np.log(1 + n) + 1)


def _some(which: np.ndarray, text: np.ndarray, slot: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The vectors of some texts, numbered anew."""
    number = np.cumsum(which) - 1
    keep = which[text]
    return number[text[keep]], slot[keep], count[keep]


def _votes_of_others(text: np.ndarray, slot: np.ndarray, count: np.ndarray, ids: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """For each example the vote of the examples that are not in its part."""
    votes = np.full(len(y), 0.5)
    part = np.arange(len(y)) % PARTS
    for p in range(PARTS):
        own, rest = part == p, part != p
        if not own.any() or not rest.any():
            continue
        t, s, c = _some(rest, text, slot, count)
        idf = term_weights(t, s, y[rest], terms)
        index = Index(t, s, weights(t, s, c, idf, int(rest.sum())), ids[rest], y[rest], terms)
        t, s, c = _some(own, text, slot, count)
        votes[own], _ = index.vote(t, s, weights(t, s, c, idf, int(own.sum())), int(own.sum()), float(y[rest].mean()))
    return votes


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, *, most: int = 2000, longest: int = LONGEST) -> dict:
    """Terms, their weights, index and calibration, all from a bounded sample of labelled rows."""
    chosen, share = examples(docs, labels, may_learn, most, longest)
    chosen = checkpointed(chosen)

    def seen(batches) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            terms = {t for text in utf8(part, "text") for w in set(words_of(text)) for t in terms_of(w)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(terms), pa.binary())], names=["term"])

    vocabulary = chosen.mapInArrow(seen, "term binary").distinct().toArrow().sort_by("term")["term"].to_pylist()
    terms = Terms(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def vectors(batches) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for part in sliced(batches, "text", SLICE):
            text, slot, count = lookup.of(utf8(part, "text"))
            cut = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (slot, count)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], names=["id", "toxic", "slot", "n"])

    rows = chosen.mapInArrow(vectors, "id long, toxic int, slot array<long>, n array<long>").orderBy(F.xxhash64("id"), "id").toArrow().combine_chunks()
    many = pa.compute.list_value_length(rows["slot"]).to_numpy()
    n = len(many)
    text, slot, count = np.repeat(np.arange(n), many), *(pa.compute.list_flatten(rows[c]).to_numpy() for c in ("slot", "n"))
    ids, y = rows["id"].to_numpy(), rows["toxic"].to_numpy().astype(np.float64)
    idf = term_weights(text, slot, y, len(vocabulary))
    index = Index(text, slot, weights(text, slot, count, idf, n), ids, y, len(vocabulary))
    prior = float(y.mean()) if n else 0.5
    votes = _votes_of_others(text, slot, count, ids, y, len(vocabulary))
    real = np.where(y == 1, share / max(prior, 1e-9), (1 - share) / max(1 - prior, 1e-9))
    slope, offset = logistic(_log_odds(votes), y, real) if n and 0 < prior < 1 else (1.0, 0.0)
    return {"terms": terms, "idf": idf, "index": index, "prior": prior, "slope": slope, "offset": offset}


EVIDENCE = ArrayType(StructType([StructField("example_id", LongType()), StructField("cosine", DoubleType()), StructField("toxic", IntegerType())]))


def scored(docs: DataFrame, model: dict, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` (None: all) plus score, predicted and evidence: all examples that voted, nearest first.

    A text without any known term, an empty or a null one has no neighbours: its vote is the examples' share of
    label 1, and it is scored like any other. With no examples every score is 0.5. Equal texts have equal scores.
    No rows give no rows. Columns of `docs` named like an output column are replaced.
    """
    made = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("evidence", EVIDENCE)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        lookup, index = m["terms"], m["index"]

        def compute(texts: list[bytes]) -> dict[str, object]:
            text, slot, count = lookup.of(texts)
            vote, (t, place, cosine) = index.vote(text, slot, weights(text, slot, count, m["idf"], len(texts)), len(texts), m["prior"])
            score = 1 / (1 + np.exp(-(m["slope"] * _log_odds(vote) + m["offset"])))
            cut = pa.array(np.searchsorted(t, np.arange(len(texts) + 1)).astype(np.int32))
            voters = pa.StructArray.from_arrays([pa.array(index.ids[place]), pa.array(cosine), pa.array(index.labels[place].astype(np.int32))], names=["example_id", "cosine", "toxic"])
            return {"score": score, "predicted": (score >= 0.5).astype(np.int32), "evidence": pa.ListArray.from_arrays(cut, voters)}

        return compute

    return with_computed(docs, text_col, StructType(made), start, keep, SLICE)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns of the toxicity query, and the evidence."""
    slim = docs.select("doc_id", "text")
    model = fit(slim, labels.select("doc_id", "toxic"), ~held_out())
    out = scored(slim.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")
