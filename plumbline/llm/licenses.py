"""License scan by ordered signature rules.

A text is read as its words, lower-cased and joined by single spaces. Which rules are tried at all is settled by
keywords: a rule names a word that each of its matches holds, and only rules whose word the text has are searched
for. Every place that a pattern matches is a detection, an interval of words with the rule's rank.

Detections are taken in order of their rules' sections, longer ones first, and one that lies within the interval of
a detection that was kept is suppressed: "GNU Lesser General Public License v2.1" is no GPL and no LGPL of unknown
version. Base rules stand outside this order: their detections always stay and suppress nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from plumbline.llm.common import pieces
from plumbline.llm.license_rules import SECTIONS
from plumbline.llm.rows import with_computed

#: A-Z are lower-cased; digits, a-z and all bytes of other characters make words, the rest of ASCII separates them.
WORDS = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))
DETECTION = StructType([StructField("label", StringType()), StructField("rule", IntegerType()), StructField("first", LongType()), StructField("last", LongType())])
MADE = StructType([
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()), StructField("detections", ArrayType(DETECTION)),
])


@dataclass(frozen=True)
class Rule:
    place: int
    section: int
    confidence: float
    keyword: bytes
    label: str
    find: Callable[[bytes], Iterable[re.Match]]


@cache
def rules() -> tuple[Rule, ...]:
    """All signatures in order; section 0 holds the base rules."""
    made: list[Rule] = []
    for section, (_, confidence, lines) in enumerate(SECTIONS):
        for line in lines.strip().splitlines():
            keyword, label, pattern = line.split(" ", 2)
            find = re.compile(rb" (?:" + pattern.encode() + rb")(?= )").finditer
            made.append(Rule(len(made), section, confidence, keyword.encode(), label, find))
    return tuple(made)


def normal(text: bytes) -> bytes:
    """The words of a text, one space before and after each; one space if it has none."""
    body = b" ".join(part for piece in pieces(text, WORDS) if (part := b" ".join(piece.split())))
    return b" " + body + b" " if body else b" "


def gated(line: bytes) -> list[Rule]:
    """The rules whose keyword the text has as a word."""
    return [r for words, own in _gates() if words in line for r in own]


@cache
def _gates() -> tuple[tuple[bytes, tuple[Rule, ...]], ...]:
    by: dict[bytes, list[Rule]] = {}
    for r in rules():
        by.setdefault(b" " + r.keyword + b" ", []).append(r)
    return tuple((k, tuple(v)) for k, v in by.items())


def standing(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """What is left of detections (first word, word behind the last, rule) when contained ones are suppressed."""
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    reach: list[int] = []  # the furthest end of all kept ones that start here or before
    for section in sorted({r.section for _, _, r in found}):
        own, far = [], -1
        for first, end, rule in sorted((d for d in found if d[2].section == section), key=lambda d: (d[0], -d[1], d[2].place)):
            i = bisect_right(starts, first)
            if end <= far or i and end <= reach[i - 1]:
                continue
            far = end
            own.append((first, end, rule))
        kept += own
        starts, reach, far = [], [], -1
        for first, end, _ in sorted(kept, key=lambda d: d[:2]):
            far = max(far, end)
            starts.append(first)
            reach.append(far)
    return kept


def _places(line: bytes, tried: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Matches as word intervals; words are counted once along the text."""
    spans = sorted((m.start(), m.end(), r.place, r) for r in tried for m in r.find(line))
    found, at, word = [], 0, 0
    for start, end, _, rule in spans:
        word += line.count(b" ", at, start)
        at = start
        found.append((word, word + line.count(b" ", start, end), rule))
    return found


def scan(text: bytes) -> dict:
    """A row of MADE."""
    line = normal(text)
    found = _places(line, gated(line))
    base = [d for d in found if not d[2].section]
    left = standing([d for d in found if d[2].section])
    every = sorted(base + left, key=lambda d: (d[0], d[1], d[2].place))
    names = {d[2].label for d in base}
    return {
        "n_words": max(line.count(b" ") - 1, 0),
        "n_base": len(base),
        "first_word": min((d[0] for d in base), default=None),
        "last_word": max((d[0] for d in base), default=None),
        "base_labels": ",".join(sorted(names)),
        "labels": ",".join(sorted(names | {d[2].label for d in left})),
        "score": max((d[2].confidence for d in every), default=0.0),
        "detections": [{"label": r.label, "rule": r.place, "first": a, "last": b - 1} for a, b, r in every],
    }


def scanned(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` (None: all) plus n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections are the places that stand, with the numbers of their first and last word. score is the confidence of
    the strongest of them. Null, empty and wordless texts have no words, no labels, null places and score 0. Equal
    texts have equal results. No rows give no rows. Columns of `docs` named like an output column are replaced.
    """

    def start():
        def compute(texts: list[bytes]) -> dict[str, object]:
            rows = [scan(t) for t in texts]
            return {f.name: [r[f.name] for r in rows] for f in MADE.fields}

        return compute

    return with_computed(docs, text_col, MADE, start, keep)


def op13(docs: DataFrame) -> DataFrame:
    """Contract columns of the licence query, and how many places stand in all."""
    found = scanned(docs.select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", *MADE.names[:-1], F.size("detections").alias("n_detections"))
