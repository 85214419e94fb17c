"""Divergence audit, centroid clusters and licence scan against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import centroids, divergence, licenses
from plumbline.llm.license_rules import SECTIONS

# divergence


def plain_divergence(docs, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = set()
    for lang in held:
        own = {s: c for (g, s), c in counts.items() if g == lang}
        terms = [t for t, n in held[lang].items() if n >= least]
        v = len(terms)
        total = Counter({t: sum(c[t] for c in own.values()) for t in terms})

        def shares(c):
            n = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in terms}  # noqa: B023

        p, q = {s: shares(c) for s, c in own.items()}, shares(total)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in terms), o) for o in own if o != s), key=lambda x: (x[0], x[1].encode()))
            best = sorted(((-gap(p[s][t], q[t]), t) for t in terms if own[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out |= {(lang, s, part, o, -x, i + 1) for part, rows in (("pair", pairs), ("term", best)) for i, (x, o) in enumerate(rows)}
    return out


def some_documents():
    rng = np.random.default_rng(3)
    words = np.array([*"abcdefghij", "Größe", "мир", "Ab", "x9y", "世界"])
    docs = [(" ".join(rng.choice(words, rng.integers(0, 30))), str(rng.choice(["en", "de"])), f"s{min(rng.integers(0, 9), 5)}") for _ in range(300)]
    odd = [(None, "en", "s0"), ("", None, None), ("a a a b", None, "s1"), ("a b", "", "s2"), ("!!! 12", "fr", "only"), ("a" * 5_000_000 + " b", "en", "s1"), (None, "xx", "p"), ("unique", "xx", "q")]
    return docs + odd + docs[:20]


@pytest.mark.parametrize("narrow", [False, True])
def test_divergence(spark, monkeypatch, narrow):
    if narrow:  # every other way: counters handed on early, groups joined by shuffle, postings in parts
        for name, value in (("ENTRIES", 3), ("BROADCAST_ROWS", 0), ("PARTS", 3), ("WIDE", 2)):
            monkeypatch.setattr(divergence, name, value)
    docs = some_documents()
    frame = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    got = [tuple(r) for r in divergence.divergence(frame, least_docs=2, top=4).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(docs, 2, 4)


def test_shares_of_very_large_counts(spark):
    row = spark.range(1).select(divergence.share(F.lit(7 * 10**14), F.lit(9 * 10**15)), divergence.share(F.lit(0), F.lit(2)), divergence.gap(F.lit(10**9), F.lit(1))).first()
    assert tuple(row) == (1 + 10**9 * (7 * 10**14 + 2) // (9 * 10**15), 1 + 10**9, (10**9 - 1) ** 2 // (10**9 + 1))


def test_divergence_of_awkward_rows(awkward, nothing):
    assert divergence.divergence(nothing).count() == 0
    got = divergence.divergence(awkward).collect()
    assert {(r["lang"], r["source"], r["item"], r["value"]) for r in got} >= {("", "", "a", 0), ("", "b", "", 0), ("en", "a", "b", 0)}
    assert not [r for r in got if r["lang"] == "de"]  # a source alone in its language


# clusters


def plain_clusters(rows, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        means = []
        for j, x in enumerate(c):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            means.append([sum(col) // len(mine) for col in zip(*mine)] if mine else x)
        c = means
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    sums = Counter()
    for _, j, d in out:
        sums[j] += d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def vectors(kind):
    rng = np.random.default_rng(7)
    if kind == "ties":  # few values, so that many distances are equal
        v = rng.integers(0, 2, (150, 64)) * (rng.random((150, 64)) < 0.1)
    elif kind == "groups":
        v = rng.normal(size=(8, 64))[rng.integers(0, 8, 300)] + rng.normal(size=(300, 64)) * 0.4
    elif kind == "large":
        v = rng.normal(size=(120, 64)) * 400_000
    else:
        v = rng.normal(size=(7, 64))
    rows = [(int(i) if i % 11 else None, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [1.0] * 63 + [float("nan")]), (505, [float("-inf")] + [0.0] * 63)]
    return rows + odd + rows[5:9]


@pytest.mark.parametrize("kind", ["ties", "groups", "large", "few"])
def test_clusters(spark, kind):
    rows = vectors(kind)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = centroids.op12(frame.withColumn("distance", F.lit("caller's"))).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows)


@pytest.mark.parametrize("keep", [1, 2, 6, 20])
def test_bounds_never_change_an_assignment(keep):
    """Bounds carried over many moves, some long and some tiny, against whole scans."""
    rng = np.random.default_rng(keep)
    v = rng.integers(-40, 40, (400, 8))
    c = v[:12].copy()
    b = centroids.Bounds.scanned(v, c, keep)
    skipped = 0
    for turn in range(12):
        new = c + rng.integers(-2, 3, c.shape) * (rng.random((12, 1)) < (0.3 if turn % 3 else 1.0))
        by = centroids.above(((new - c) ** 2).sum(axis=1))
        c = new
        before = b.up.copy()
        b.moved(v, c, by)
        d = centroids.squares(v, c)
        assert (b.near[:, 0] == d.argmin(axis=1)).all()
        rest = np.sqrt(np.take_along_axis(d, b.near[:, 1:], axis=1))
        assert (b.low[:, :-1][:, : rest.shape[1]] <= rest).all() and (b.up >= np.sqrt(d.min(axis=1))).all()
        others = np.ones(d.shape, bool)
        np.put_along_axis(others, b.near, False, axis=1)
        assert (b.low[:, -1] <= np.where(others, np.sqrt(d), np.inf).min(axis=1)).all()
        skipped += int((b.up > before).sum())
        if turn == 6:
            b.cut(max(1, keep - 1))
    assert skipped  # some rows were certified by their bounds alone


def test_clusters_of_nothing_and_of_too_large_values(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.op12(empty).count() == 0
    big = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.op12(big).count()


# licences


def plain_scan(text):
    """All rules tried on the whole text, every pair of detections compared."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
    line = " " + " ".join(words) + " "
    found = []
    for section, (_, confidence, lines) in enumerate(SECTIONS):
        for rank, row in enumerate(lines.strip().splitlines()):
            _, label, pattern = row.split(" ", 2)
            for m in re.finditer(f" (?:{pattern})(?= )", line, re.ASCII):
                found.append((line[: m.start()].count(" "), line[: m.end()].count(" "), section, rank, label, confidence))
    base = [f for f in found if f[2] == 0]
    order = sorted((f for f in found if f[2]), key=lambda f: (f[2], f[0] - f[1], f[3]))
    kept = []
    for f in order:
        if not any(k[0] <= f[0] and f[1] <= k[1] for k in kept):
            kept.append(f)
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    places = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = {label for _, label in places}
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {k[4] for k in kept})), max([f[5] for f in kept + base], default=0.0))


def sample_of(pattern):
    """A text that a rule's pattern matches: optional parts dropped, first alternatives taken."""
    pattern = pattern.replace(" ?", "").replace(r"\S+", "word").replace(r"\d\d", "19")
    while (m := re.search(r"\(\?:([^()]*)\)(\{(\d+),\d+\}\??|\?)?", pattern)) :
        many = 0 if m[2] == "?" else int(m[3]) if m[3] else 1
        pattern = pattern[: m.start()] + m[1].split("|")[0] * many + pattern[m.end() :]
    return re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"(\w)\?", "", pattern))


def test_every_rule_finds_its_text_and_holds_its_keyword():
    assert len(licenses.rules()) > 200
    for rule, line in zip(licenses.rules(), [x for _, _, lines in SECTIONS for x in lines.strip().splitlines()]):
        text = sample_of(line.split(" ", 2)[2])
        padded = b" zz " + text.encode() + b" zz "
        assert [m.group().strip().decode() for m in rule.find(padded)] == [text], line
        assert rule.keyword.decode() in text.split(), line
        assert rule in licenses.gated(padded)


def licence_texts():
    rng = np.random.default_rng(5)
    parts = [sample_of(x.split(" ", 2)[2]) for _, _, lines in SECTIONS for x in lines.strip().splitlines()]
    parts += ["GNU Lesser General Public License v2.1 or later", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by cc by", "ALL RIGHTS RESERVED", "all rights", "lorem", "ipsum — Größe", "reserved", "MIT License"]
    texts = [", ".join(rng.choice(parts, rng.integers(1, 12)).tolist()) for _ in range(400)]
    return [*texts, None, "", "!! ?", "Überall rights reserved", "all rights reserved " * 3000, "general public license" + " x" * 200_000 + " cc by", "cc\x00by \x85 cc_by ccby CC-BY"]


def test_licences(spark):
    texts = licence_texts()
    frame = spark.createDataFrame([(i, t, "caller's", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score int")
    got = {r["doc_id"]: tuple(r[c] for c in licenses.MADE.names[:-1]) for r in licenses.scanned(frame).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_scan(t), t and t[:200]
    assert licenses.op13(frame.filter("false")).count() == 0


def test_licences_suppress_what_they_contain(spark):
    row = licenses.scan(b"Licensed under the GNU Lesser General Public License v2.1 or later, (c) all rights reserved")
    assert row["labels"] == "gpl,lgpl-2.1-or-later,reserved" and row["base_labels"] == "gpl,reserved" and (row["first_word"], row["last_word"]) == (5, 13)
    assert licenses.scan(b"GNU General Public License, version 3")["labels"] == "gpl,gpl-3.0"


def test_licences_of_awkward_rows(awkward):
    out = licenses.scanned(awkward)
    assert out.count() == awkward.count() and set(awkward.columns) <= set(out.columns)
    assert {r["n_base"] for r in out.collect()} == {0}
