"""Language identification with spans of mixed-language text.

A word's score for a language is the sum of log probabilities of its character pairs and triples, word boundaries
included. A word is scored for the languages whose learned script ranges hold most of its letters; the others are
out. The Viterbi path over a text's words, with a penalty for each switch, labels every word; runs of one label are
the text's spans. The text's language is the one with most letters in its spans.

The model is learned from a bounded sample of labelled texts (`per_lang` for each language in expectation, by a hash
of the id, whole texts). Paths are found for many texts at a time, one word of each per step; a very long text is cut
into blocks that are followed side by side and chained by the best gains between their ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from plumbline.llm.common import checkpointed
from plumbline.llm.rows import with_computed

#: First code points of script ranges, and their scripts. Fixed values.
SCRIPTS = [
    (0x0041, "Latin"), (0x0300, "Marks"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Yi"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
FIRST = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS], np.int16)
SLOTS = 1 << 16
#: A script is a language's own if at least this share of its letters is in it.
OWN_SHARE = 0.02
SWITCH = 12.0
#: Bytes of text that are scored together; arrays are about 50 times as large.
SLICE = 2 << 20
UNDETERMINED = "und"
#: A table of shares of at most so many languages is broadcast; a larger one is joined by shuffling both sides.
FEW_LANGS = 10_000


class Letters:
    """Letters of some texts as one array: code points lower-cased, the word and text of each, and word starts."""

    def __init__(self, texts: list[str]):
        texts = [t.lower() for t in texts]
        code = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
        low = code < 128
        letter = np.zeros(len(code), bool)
        letter[low] = LETTER[code[low]]
        high = np.flatnonzero(~low)
        if len(high):
            kinds, back = np.unique(code[high], return_inverse=True)
            letter[high] = np.array([chr(c).isalpha() for c in kinds.tolist()])[back]
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        at = np.flatnonzero(letter)
        self.code = code[at]
        if len(at):
            new = np.concatenate(([True], np.diff(at) > 1))
        else:
            new = np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.text = np.searchsorted(ends, at[self.start], side="right")
        self.place = at[self.start] - (ends - lengths)[self.text] if len(at) else at
        self.size = np.diff(np.concatenate((self.start, [len(at)])))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the pair and of the triple that end at each letter, a boundary standing before each word."""
        c = self.code
        one, two = np.roll(c, 1), np.roll(c, 2)
        one[self.start] = 0
        two[self.start] = 0
        second = self.start[self.size > 1] + 1
        two[second] = 0
        pair = one * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA77)
        three = two * np.uint32(0xC2B2AE3D) + one * np.uint32(0x27D4EB2F) + c * np.uint32(0x165667B1)
        for x in (pair, three):
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x >>= np.uint32(16)
        return pair, three

    def scripts(self) -> np.ndarray:
        return SCRIPT_OF[np.maximum(np.searchsorted(FIRST, self.code, side="right") - 1, 0)]


LETTER = np.array([chr(c).isalpha() for c in range(128)])


def fit(labelled: DataFrame) -> dict:
    """Model from (lang, text): gram log probabilities by language and the scripts that are each language's own."""

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text or "")
            for lang, texts in by.items():
                letters = Letters(texts)
                pair, three = letters.grams()
                sums = held.setdefault(lang, [np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.zeros(len(NAMES), np.int64)])
                for s, x in zip(sums, (pair, three, letters.scripts())):
                    s += np.bincount(x, minlength=len(s))
        for lang, sums in held.items():
            for kind, s in enumerate(sums):
                slot = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(np.full(len(slot), kind, np.int32)), pa.array(slot.astype(np.int32)), pa.array(s[slot])], names=["lang", "kind", "slot", "n"])

    rows = labelled.select("lang", "text").mapInArrow(count, "lang string, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    sums = [np.zeros((size, len(langs))) for size in (SLOTS, SLOTS, len(NAMES))]
    for kind, s in enumerate(sums):
        part = rows[rows["kind"] == kind]
        s[part["slot"].to_numpy(), np.searchsorted(langs, part["lang"].to_numpy().astype(str)) if len(langs) else []] = part["n"].to_numpy()
    logs = [np.log((s + 0.05) / (s.sum(axis=0) + 0.05 * 4000)).astype(np.float32) for s in sums[:2]]
    share = sums[2] / np.maximum(sums[2].sum(axis=0), 1)
    return {"langs": langs, "pair": logs[0], "three": logs[1], "own": share >= OWN_SHARE}


def scores(model: dict, texts: list[str]) -> tuple[Letters, np.ndarray]:
    """Letters of the texts and the score of each word for each language (words, langs)."""
    letters = Letters(texts)
    n = len(model["langs"])
    if not n or not len(letters.start):
        return letters, np.zeros((len(letters.start), n), np.float32)
    pair, three = letters.grams()
    score = np.add.reduceat(model["pair"][pair] + model["three"][three], letters.start, axis=0)
    own = np.add.reduceat(model["own"][letters.scripts()], letters.start, axis=0, dtype=np.int32) * 2 > letters.size[:, None]
    own |= ~own.any(axis=1, keepdims=True)
    return letters, np.where(own, score, np.float32(-1e6) + score)


def viterbi(score: np.ndarray, text: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word: texts are contiguous runs of words and are followed together, longest first."""
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    length = np.diff(np.concatenate((first, [len(text)])))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0]), side="left")
    best = score[first].copy()
    from_ = np.zeros(len(text), np.int16)
    stay = np.ones(score.shape, bool)
    for step in range(1, length[0]):
        k = live[step]
        at, held = first[:k] + step, best[:k]
        top = held.argmax(axis=1)
        other = held[np.arange(k), top][:, None] - switch
        from_[at] = top
        stay[at] = held >= other
        best[:k] = np.maximum(held, other) + score[at]
    out = np.zeros(len(text), np.int16)
    now = best.argmax(axis=1).astype(np.int16)
    for step in range(length[0] - 1, -1, -1):
        k = live[step]
        at = first[:k] + step
        out[at] = now[:k]
        if step:
            now[:k] = np.where(stay[at, now[:k]], now[:k], from_[at])
    return out


class Blocks:
    """Stretches of one long text, each cut into blocks of words that are followed side by side.

    First a block's best gains from every language at its start to every language at its end are found, as a matrix
    for each block; these are chained to the real gains at the start of each block; then all blocks are followed once
    more from there, and what is kept of a stretch are the ways back. Gains are in double precision and start from
    their largest in each block, so they stay exact enough however long the text is.
    """

    #: Elements of the matrices of a stretch.
    MATRICES = 1 << 21

    def __init__(self, langs: int, switch: float):
        self.entry, self.switch, self.back = np.zeros(langs), switch, []

    def add(self, score: np.ndarray) -> None:
        """The scores of the next words."""
        n, k = score.shape
        if not n:
            return
        blocks = max(1, min(math.isqrt(n), self.MATRICES // (k * k)))
        width = -(-n // blocks)
        padded = np.zeros((blocks * width, k))  # words without a preference change nothing
        padded[:n] = score
        padded = padded.reshape(blocks, width, k)
        gain = np.full((blocks, k, k), -np.inf)
        gain[:, np.arange(k), np.arange(k)] = 0
        for step in range(width):
            gain = np.maximum(gain, gain.max(axis=2, keepdims=True) - self.switch) + padded[:, step, None, :]
        held = np.empty((blocks, k))
        for b in range(blocks):
            held[b] = self.entry
            self.entry = (self.entry[:, None] + gain[b]).max(axis=0)
            self.entry -= self.entry.max()
        stay, from_ = np.empty((blocks, width, k), bool), np.empty((blocks, width), np.int16)
        for step in range(width):
            from_[:, step] = top = held.argmax(axis=1)
            other = held[np.arange(blocks), top][:, None] - self.switch
            stay[:, step] = held >= other
            held = np.maximum(held, other) + padded[:, step]
        self.back.append((n, np.packbits(stay, axis=2), from_))

    def labels(self) -> np.ndarray:
        """Best label of each word."""
        out, end, k = [], int(self.entry.argmax()), len(self.entry)
        for n, packed, from_ in reversed(self.back):
            stay = np.unpackbits(packed, axis=2, count=k).astype(bool)
            blocks, width = from_.shape
            row, came = np.arange(blocks)[:, None], np.tile(np.arange(k), (blocks, 1))
            for step in range(width - 1, -1, -1):
                came = np.where(stay[row, step, came], came, from_[:, step, None])
            last = np.empty(blocks, np.int64)
            for b in range(blocks - 1, -1, -1):
                last[b], end = end, int(came[b, end])
            word = np.empty((blocks, width), np.int16)
            row = row[:, 0]
            for step in range(width - 1, -1, -1):
                word[:, step] = last
                last = np.where(stay[row, step, last], last, from_[:, step])
            out.append(word.ravel()[:n])
        return np.concatenate(out[::-1]) if out else np.zeros(0, np.int16)


def labelled_words(model: dict, texts: list[str], switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the texts: the text, the first place, the number of letters, and the language.

    A text of more than SLICE letters is read in pieces that end between words; scores are held for a piece only.
    """
    if len(texts) == 1 and len(texts[0]) > SLICE:
        whole, at = texts[0].lower(), 0
        start, size, found = [], [], Blocks(len(model["langs"]), switch)
        while at < len(whole):
            end = at + SLICE
            while end < len(whole) and whole[end].isalpha():
                end += 1
            letters, score = scores(model, [whole[at:end]])
            start.append((letters.place + at).astype(np.int64))
            size.append(letters.size)
            if score.size:
                found.add(score)
            at = end
        start, size = np.concatenate(start), np.concatenate(size)
        word = found.labels() if model["langs"] else np.zeros(len(start), np.int16)
        return np.zeros(len(start), np.int64), start, size, word
    letters, score = scores(model, texts)
    text, start, size = letters.text, letters.place, letters.size
    word = viterbi(score, text, switch) if score.size else np.zeros(len(text), np.int16)
    return text, start, size, word


def _judge(model: dict) -> Callable[[list[bytes]], dict[str, object]]:
    langs = model["langs"]

    def compute(raw: list[bytes]) -> dict[str, object]:
        texts = [t.decode("utf-8", "replace") for t in raw]
        text, start, size, word = labelled_words(model, texts)
        n = len(langs)
        mass = np.bincount(text * max(n, 1) + word, size, minlength=len(texts) * max(n, 1)).reshape(len(texts), max(n, 1))
        total = mass.sum(axis=1)
        top = mass.argmax(axis=1)
        share = mass[np.arange(len(texts)), top] / np.maximum(total, 1)
        known = (total > 0) & (n > 0)
        names = pa.array([*langs, UNDETERMINED], pa.string())
        turn = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])))) if n and len(word) else np.empty(0, np.int64)
        last = np.append(turn[1:], len(word))[: len(turn)] - 1
        spans = pa.StructArray.from_arrays([names.take(pa.array(word[turn])), pa.array(start[turn].astype(np.int32)), pa.array((start[last] + size[last]).astype(np.int32))], names=["lang", "start", "end"])
        cut = pa.array(np.searchsorted(text[turn], np.arange(len(texts) + 1)).astype(np.int32))
        return {"lang_pred": names.take(pa.array(np.where(known, top, n))), "score": np.where(known, share, 0.0), "spans": pa.ListArray.from_arrays(cut, spans)}

    return compute


SPAN = StructType([StructField("lang", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def identify(docs: DataFrame, model: dict, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` (None: all) plus lang_pred, score and spans (lang, start, end).

    score: share of the letters whose words carry the text's language. Null, empty and letterless texts, and all
    texts under a model that learned nothing, are `und` with score 0 and no spans. Ties go to the first language by
    code point. start and end count code points of the lower-cased text. Repeated rows have equal results; no rows
    give no rows. Columns of `docs` named like an output column are replaced.
    """
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(SPAN))]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_computed(docs, text_col, StructType(made), lambda: _judge(shared.value), keep, SLICE)


def labelled_sample(docs: DataFrame, may_learn: Column, *, per_lang: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text) of about `per_lang` rows of each language for which `may_learn` holds, chosen by a hash of the id."""
    rows = docs.filter(may_learn & F.col(lang_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("_lang")).agg((float(per_lang) / F.count("*")).alias("_share"))
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("_draw"))
    counts = checkpointed(counts)
    few = F.broadcast(counts) if counts.count() <= FEW_LANGS else counts
    return drawn.join(few, (F.col("lang") == F.col("_lang")) & (F.col("_draw") < F.col("_share"))).select("lang", "text")


def lettered(text_col: str) -> Column:
    """Whether a text has a letter; null for a null text. Without one, identify() gives `und` under every model."""
    return F.col(text_col).rlike(r"\p{L}")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op6(docs: DataFrame) -> DataFrame:
    """Contract columns of the language query, and the spans."""
    slim = docs.select("doc_id", "text", "lang")
    model = fit(labelled_sample(slim, ~held_out()))
    out = identify(slim.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "spans")
