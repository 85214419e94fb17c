"""Operators against plain Python on small tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import oracle
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import audio, blocks, chat, components, decontam, hilbert, html_text, labeller, langid, mixing, simhash, substrings, template, toxicity
from plumbline.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, sf_dir, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLES[name]) == ""


def copies(spark, n=120, seed=4):
    """Texts with exact and near copies, and shared passages."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 160))]
        if i % 3 == 1:
            w = list(texts[-1])
            if w and i % 2:
                w[rng.randrange(len(w))] = "EDIT"
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[: rng.randrange(20, 60)]
        if i % 11 == 0:
            w = ["same"] * rng.randrange(30, 90)
        texts.append(w)
    return spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), texts


def bits(text, n=3):
    w = [x for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    df, texts = copies(spark)
    fps = [bits(" ".join(t)) for t in texts]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3(df).collect()}
    assert got == {i: (f"{f:016x}", root(i)) for i, f in enumerate(fps)}


@pytest.mark.parametrize("limit", [1, 5, 17, 4 << 20])
def test_fingerprints_of_texts_in_pieces(limit):
    rng = random.Random(limit)
    for n in [*range(8), 60, 300]:
        text = "".join(rng.choice(["Ab", "c\u00c4", "ddd", "\u00a0e"]) + rng.choice([" ", "\t", "\n\n", " \x0b", "\r", "\x0c"]) for _ in range(n))
        assert simhash.fingerprint(text.encode(), limit=limit) == bits(text)
    assert simhash.fingerprint(b"one word" * 3000, limit=limit) == bits("one word" * 3000)


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in np.repeat(base, 8)]
    fps = sorted(set(near) | {0, 1, 7, 15, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(max(signed[i], signed[j]), min(signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    assert got == want and len(want) > 50


def test_components_of_paths_stars_and_cycles(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(900, i) for i in range(200, 260)]
    ring = [(i, 500 + (i - 499) % 17) for i in range(500, 517)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(path + star + ring + [(3, 3)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 200 for i in [*range(200, 260), 900]} | {i: 500 for i in range(500, 517)}


def plain_passages(texts):
    """Number of words, number removed and kept text of each text."""
    count = Counter(tuple(t[i : i + 35]) for t in texts for i in range(len(t) - 34))
    want = {}
    for k, t in enumerate(texts):
        gone = {p for i in range(len(t) - 34) if count[tuple(t[i : i + 35])] > 1 for p in range(i, i + 35)}
        want[k] = (len(t), len(gone), " ".join(x for p, x in enumerate(t) if p not in gone))
    return want


@pytest.mark.parametrize("close, few", [(substrings.CLOSE, substrings.FEW), (2, 50), (0, 0)])
def test_passages(spark, monkeypatch, close, few):
    """Anchors compared pair by pair, some or all joined on longer seeds, with and without frequent ones: the same words go."""
    monkeypatch.setattr(substrings, "CLOSE", close)
    monkeypatch.setattr(substrings, "FEW", few)
    df, texts = copies(spark)
    want = plain_passages(texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(df).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_extensions_word_by_word():
    rng, side = np.random.default_rng(8), 5
    seed = np.sort(rng.integers(0, 9, 60))
    core = rng.integers(0, 2, 60)  # rows of one seed whose anchors are other words
    words = rng.integers(1, 3, (60, 2 * side))
    left, right = rng.integers(0, side + 1, (2, 60))
    want = [(-1, -1)] * 60
    for i in range(60):
        for j in range(60):
            if i != j and seed[i] == seed[j] and core[i] == core[j]:
                l = r = 0
                while l < min(left[i], left[j]) and words[i, l] == words[j, l]:
                    l += 1
                while r < min(right[i], right[j]) and words[i, side + r] == words[j, side + r]:
                    r += 1
                if l + r >= side:
                    want[i] = (max(want[i][0], l), max(want[i][1], r))
    got = substrings.extended(seed, core, left, right, words)
    assert list(zip(*(x.tolist() for x in got))) == want and 0 < sum(w != (-1, -1) for w in want) < 60


def test_colliding_words_are_told_apart(spark):
    """Words that collide in every polynomial hash modulo 2^64, over 1,000 letters each, and their copies."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(35)]
    texts = [" ".join([*rest[:17], w, *rest[18:]]) for w in (word, other, other)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["removed"]) for r in substrings.without_repeats(rows).collect()}
    assert got[0] == (0, []) and got[1] == got[2] and got[1][0] == 35
    assert {r["n_removed"] for r in substrings.without_repeats(rows.filter("doc_id < 2")).collect()} == {0}


@pytest.mark.parametrize("close", [substrings.CLOSE, 2, 0])
def test_passages_with_a_weak_hash(spark, monkeypatch, close):
    """A hash of four values brings unlike words together everywhere; none is taken for another."""
    monkeypatch.setattr(substrings, "CLOSE", close)
    monkeypatch.setattr(substrings, "WORD_HASH", lambda w: len(w) + w[-1] & 3)
    df, texts = copies(spark, 60)
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substrings.without_repeats(df).collect()}
    assert got == {k: (gone, kept) for k, (_, gone, kept) in plain_passages(texts).items()}


def test_equal_anchors_of_a_seed_meet_once_over_batches():
    keys = [(1, 5, 2)] * 3 + [(1, 6, 2), (2, 5, 4)] + [(3, k // 2, 0) for k in range(10)] + [(4, 0, 0)] * 2
    table = pa.table({n: [k[i] for k in keys] for i, n in enumerate(("seed", "sum", "at"))})
    for size in (1, 2, 4, 100):
        parts = [list(zip(*(c.to_pylist() for c in t.columns))) for t in substrings._whole_seeds(iter(table.to_batches(size)))]
        assert [k for p in parts for k in p] == sorted(set(keys))
        assert all(not {k[0] for k in p} & {k[0] for k in q} for n, p in enumerate(parts) for q in parts[:n])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc"]), min_size=35, max_size=140))
def test_equal_windows_share_an_anchor(words):
    h = substrings.word_hashes([w.encode() for w in words])
    at, _ = substrings.anchors(h, 35)
    chosen = {}
    for i in range(len(words) - 34):
        inside = [a - i for a in at.tolist() if i <= a <= i + 27]
        assert inside
        key = tuple(words[i : i + 35])
        chosen[key] = chosen.get(key, set(inside)) & set(inside)
        assert chosen[key]


def test_benchmark_in_small_blocks(spark):
    rng = random.Random(2)
    vocab = ["la", "le", "li", "un", "der", "café", "x1"]
    docs = [" ".join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(rng.randrange(0, 200))) for _ in range(60)]
    bench = [d[5:120] for d in docs[::7]] + ["le", "li, un", "", "La LE li", "zzz"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {}
    for i, b in enumerate(bench):
        w = norm(b)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = {}
    for i, d in enumerate(docs):
        w, hit, items = norm(d), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        want[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    for rows in (60, 300, 200_000):  # many passes, one pass of several blocks, one block
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.decontaminated(df, b, block_rows=rows).collect()}
        assert got == want


def test_mix_meets_targets_with_weights(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "b", None, "c"]), rng.choice([1.0, 4.0, 0.0, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    for weight in (None, "q"):
        out = mixing.mix_sources(df, weight_col=weight).toPandas()
        assert len(out) == 3000 and out.copies.between(0, 3).all() and (out.taken == out.copies * out["size"]).all()
        g = out.fillna({"source": "~"}).groupby("source").agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"))
        assert g.target.sum() == pytest.approx(g["size"].sum()) and (g.target <= 3 * g["size"] + 1e-6).all()
        may = out[out.q > 0] if weight else out
        full = (may.fillna({"source": "~"}).assign(open=may.copies < 3).groupby("source").open.sum() == 0).reindex(g.index, fill_value=True)
        assert (((g.taken - g.target).abs() <= 60) | (full & (g.taken < g.target))).all()
        if weight:
            assert (out[~(out.q > 0)].copies == 0).all()
        else:
            assert out[out["size"] >= 32].copies.mean() > 1.2 * out[out["size"] < 8].copies.mean()
    heavy = out[out.q == 4].copies.mean()
    assert heavy > out[out.q == 1].copies.mean() and out[(out.q == 0) & (out.source == "a")].copies.mean() < heavy


def met(df):
    out = mixing.mix_sources(df).toPandas().fillna({"source": "~"})
    g = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), longest=("size", "max"))
    assert ((g.taken - g.target).abs() <= g.longest).all(), g
    return out


def test_mix_splits_equal_rows_and_null_ids(spark, monkeypatch):
    """Repeated rows and rows without an id do not stand or fall together."""
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 90)))
    again, other = text(), [(i, text(), "b") for i in range(1000, 1300)]
    met(spark.createDataFrame([(i, text(), "a") for i in range(300)] + [(7, again, "a")] * 300 + other, "doc_id long, text string, source string"))
    met(spark.createDataFrame([(None, text(), "a") for _ in range(600)] + other, "doc_id long, text string, source string"))
    alike = spark.createDataFrame([(None, again, "a")] * 900 + other, "doc_id long, text string, source string")
    out = met(alike)
    assert sorted(map(str, met(alike.repartition(7)).values.tolist())) == sorted(map(str, out.values.tolist()))
    met(alike.withColumn("size", F.lit("caller's")))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    many = spark.createDataFrame([(i, text(), None if i % 9 == 0 else f"s{i % 50}") for i in range(800)], "doc_id long, text string, source string")
    ranged = mixing.mix_sources(many).select("doc_id", "target", "copies").collect()
    monkeypatch.undo()
    assert sorted(map(tuple, ranged)) == sorted(map(tuple, mixing.mix_sources(many).select("doc_id", "target", "copies").collect()))


def test_targets_stop_and_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a stops at 30; b and c share the rest of 2015 two to one with the null source, which weighs 5 and stops at 15
    assert got["a"] == 30 and got[None] == 15 and got["b"] == pytest.approx(1970 * 2 / 3) and got["c"] == pytest.approx(1970 / 3)


def test_hilbert_steps_are_neighbours(spark):
    for dims, width in ((2, 3), (3, 2), (4, 2)):
        cells = spark.range(1 << (dims * width)).select(*[F.shiftright("id", width * d).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias(f"c{d}") for d in range(dims)])
        rows = cells.withColumn("h", hilbert.curve_index([F.col(f"c{d}") for d in range(dims)], width)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(1 << (dims * width)))
        assert all(sum(abs(x - y) for x, y in zip(a[:-1], b[:-1])) == 1 for a, b in zip(rows, rows[1:]))


def test_shard_law(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = hilbert.op7(docs).toPandas()
    n = out.groupby("shard").size()
    assert len(n) == 24 and n.max() - n.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)
    text = docs.toPandas().set_index("doc_id").text
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out.rename(columns={"size": "size"}).itertuples())
    spread = hilbert.hilbert_shards(docs).groupBy("shard").agg(F.count_distinct("lang").alias("langs")).agg(F.avg("langs")).first()[0]
    assert spread < 3


def plain_levels(values, levels=8):
    """Share of rows below each value, in eighths; null is below all."""
    key = lambda v: (v is not None, v if v is not None else 0)
    ordered = sorted(values, key=key)
    first = {}
    for i, v in enumerate(ordered):
        first.setdefault(v, i)
    return [first[v] * levels // len(values) for v in values]


def test_shards_follow_the_curve(spark):
    """The whole order against a plain sort by the curve, and each level against a count of rows below."""
    rng = random.Random(4)
    rows = [(i * 7 if i else 10**15, "x" * int(rng.expovariate(0.02)), rng.choice(["en", "de", None]), f"source{rng.randrange(6)}") for i in range(1500)] + [(1, "y", "zz", "web"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {(r.doc_id, r.text): r for r in hilbert.hilbert_shards(docs).collect()}
    machine = hilbert.transitions()
    exact = [plain_levels([r[3] for r in rows]), plain_levels([r[2] for r in rows]), plain_levels([len((r[1] or "").encode()) + 8 for r in rows]), plain_levels([r[0] for r in rows])]

    def index(levels):
        at = out_ = 0
        for bit in (2, 1, 0):
            digit = 0
            for v in levels:
                digit = digit * 2 + (v >> bit & 1)
            at = machine[(at >> 4) * 16 + digit]
            out_ = out_ * 16 + (at & 15)
        return out_

    dense = [{v: i for i, v in enumerate(sorted(set(e)))} for e in exact]
    order = sorted(range(len(rows)), key=lambda i: (out[rows[i][:2]].shard, out[rows[i][:2]].slot))
    place = [index([d[e[i]] for d, e in zip(dense, exact)]) for i in order]
    assert place == sorted(place)


def test_shards_with_a_stray_name_and_equal_rows(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(90), "en", f"source{rng.randrange(6)}") for i in range(6000)]
    for more in ([], [(6000, "x", "en", "web")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string")
        near = hilbert.hilbert_shards(docs).groupBy("shard").agg(F.count_distinct("source").alias("n")).agg(F.avg("n")).first()[0]
        assert near < 4
    docs = spark.createDataFrame(rows[:500] + [(None, "same", "en", "a")] * 700 + [(None, "same", "de", "b")] * 90, "doc_id long, text string, lang string, source string")
    out = hilbert.hilbert_shards(docs, 5, equal=50)
    found = out.toPandas()
    assert [sorted(g) == list(range(258)) for _, g in found.groupby("shard").slot] == [True] * 5
    assert docs.exceptAll(out.select(*docs.columns)).count() == 0


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(6)
    n, terms = 700, 400
    slots = [np.unique(np.concatenate((rng.choice(12, 5), 12 + 97 * (i % 4) + rng.choice(97, rng.integers(0, 9))))) for i in range(n)]
    slots[3] = slots[4] = slots[5]
    text, slot = np.repeat(np.arange(n), [len(x) for x in slots]), np.concatenate(slots)
    w = toxicity.weights(text, slot, np.ones(len(slot)), rng.uniform(0.2, 3, terms), n)
    index = toxicity.Index(text, slot, w, np.arange(n), np.zeros(n), terms)
    dense = np.zeros((n, terms))
    dense[text, slot] = w
    full = np.round(dense @ dense[index.order].T, 9)
    for without in (None, np.argsort(index.order)):
        if without is not None:
            full[np.arange(n), without] = 0
        t, place, cosine = index.nearest(text, slot, w, n, without=without)
        assert index.read < index.blocks * (n % toxicity.ASKED)
        for i in range(n):
            best = np.lexsort((np.arange(n), -full[i]))[: min(15, (full[i] > 0).sum())]
            assert np.array_equal(place[t == i], best) and np.allclose(cosine[t == i], full[i][best], atol=2e-9)
    assert [len(x) for x in index.nearest(*(np.empty(0, np.int64),) * 2, np.empty(0), 3)] == [0, 0, 0]


def brute_scores(texts, labelled, model):
    """Evidence (example, cosine) and score of each text by comparing all terms with all examples."""
    terms = [Counter(t for w in toxicity.words_of(x.encode()) for t in toxicity.terms_of(w)) for x in texts]
    df = Counter(t for i in labelled for t in terms[i])
    n1 = sum(labelled.values())
    n0 = len(labelled) - n1
    a, b = (Counter(t for i, y in labelled.items() if y == want for t in terms[i]) for want in (1, 0))
    chi = {t: len(labelled) * (a[t] * (n0 - b[t]) - b[t] * (n1 - a[t])) ** 2 / max((a[t] + b[t]) * (len(labelled) - a[t] - b[t]) * n1 * n0, 1.0) for t in a | b}
    idf = {t: (np.log((1 + len(labelled)) / (1 + df[t])) + 1) * np.sqrt(max(chi.get(t, 0), 1)) for c in terms for t in c}
    vectors = [{t: (1 + np.log(n)) * idf[t] for t, n in c.items()} for c in terms]
    norms = [np.sqrt(sum(w * w for w in v.values())) or 1.0 for v in vectors]
    for v, norm in zip(vectors, norms):
        near = sorted(((-sum(w * vectors[i].get(t, 0) for t, w in v.items()) / norm / norms[i], i) for i in labelled))
        near = [(i, -c) for c, i in near[:15] if c < 0]
        pull = [1 / (1 - min(c, 1) + toxicity.SOFT) for _, c in near]
        vote = (sum(p * labelled[i] for p, (i, _) in zip(pull, near)) + n1 / len(labelled)) / (sum(pull) + 1)
        odds = np.log(np.clip(vote, 1e-4, 1 - 1e-4) / (1 - np.clip(vote, 1e-4, 1 - 1e-4)))
        yield near, 1 / (1 + np.exp(-(model["slope"] * odds + model["offset"])))


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) if rng.random() < 0.5 else "word%d" % rng.randrange(900) for _ in range(rng.randrange(20, 60))) for _ in range(300)]
    texts[1] = "rarely seen insultword beside alpha"
    texts += ["beta insultword gamma never", "", "?! ..", "GRÖSSE Größenwahn мир", "alpha " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(250)] + [(3, 0), (7, None)], "doc_id long, toxic int")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))}
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    out = {r.doc_id: r for r in toxicity.op2(docs, labels).collect()}
    labelled = {i: i % 2 for i in range(250) if not held[i]}
    for i, (near, score) in enumerate(brute_scores(texts, labelled, model)):
        r = out[i]
        assert r.held_out == held[i] and r.score == pytest.approx(score, abs=1e-6) and r.predicted == int(r.score >= 0.5)
        assert np.allclose([e.cosine for e in r.evidence], [c for _, c in near], atol=1e-6)
        assert all(e.toxic == labelled[e.example_id] for e in r.evidence)
    assert out[1].evidence and out[300].evidence[0].example_id == 1 and not out[301].evidence


def test_calibration_votes_have_not_seen_their_example():
    """Turning the label of one example moves no vote on its own part."""
    rng = np.random.default_rng(4)
    n, terms = 60, 40
    slots = [np.unique(rng.choice(terms, 8)) for _ in range(n)]
    text, slot = np.repeat(np.arange(n), [len(x) for x in slots]), np.concatenate(slots)
    y = rng.integers(0, 2, n).astype(float)
    votes = toxicity._votes_of_others(text, slot, np.ones(len(slot)), np.arange(n), y, terms)
    turned = y.copy()
    turned[7] = 1 - turned[7]
    again = toxicity._votes_of_others(text, slot, np.ones(len(slot)), np.arange(n), turned, terms)
    own = np.arange(n) % toxicity.PARTS == 7 % toxicity.PARTS
    assert np.array_equal(votes[own], again[own]) and not np.array_equal(votes[~own], again[~own])


def test_toxicity_learns_from_texts_up_to_a_length(spark):
    docs = spark.createDataFrame([(1, "a " * 50), (2, "b"), (3, None), (4, "é" * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id long, toxic int")
    rows, _ = toxicity.examples(docs, labels, F.lit(True), 1000, 50)
    assert [r.id for r in rows.collect()] == [2]


def test_toxicity_learns_a_repeated_id_once(spark):
    docs = spark.createDataFrame([(1, "b c"), (1, "a b"), (2, "d e"), (None, "f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows, share = toxicity.examples(docs, labels, F.lit(True), 1000)
    assert sorted(map(tuple, rows.collect())) == [(1, "a b", 1), (2, "d e", 0)] and share == pytest.approx(2 / 3)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.op2(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.toxic).mean() > 0.93
    rank = out.score.rank()
    n1, n0 = out.toxic.sum(), (1 - out.toxic).sum()
    assert (rank[out.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.85


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = langid.op6(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 40 and (held.lang == held.lang_pred).mean() > 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out.itertuples())


def test_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        score = rng.normal(size=(n, 3)).astype(np.float32)
        path = langid.viterbi(score, np.zeros(n, int), 0.7)
        value = lambda p: sum(score[i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))), abs=1e-5)


@pytest.mark.parametrize("langs, matrices", [(1, 1 << 21), (2, 1 << 21), (5, 60), (9, 1 << 21)])
def test_viterbi_in_blocks_equals_one_run(monkeypatch, langs, matrices):
    monkeypatch.setattr(langid.Blocks, "MATRICES", matrices)
    rng = np.random.default_rng(langs)
    score = rng.normal(size=(3000, langs)) + 1.5 * np.repeat(rng.normal(size=(30, langs)), 100, axis=0)
    score[700:760] = 0  # words without a preference
    for cuts in ([], [1], [1000, 1001, 2500], list(range(50, 3000, 50))):
        found = langid.Blocks(langs, 2.5)
        for part in np.split(score, cuts):
            found.add(part)
        assert np.array_equal(found.labels(), langid.viterbi(score, np.zeros(3000, int), 2.5))
    assert len(langid.Blocks(langs, 1.0).labels()) == 0


def test_language_of_a_very_long_text():
    """Each of many short stretches keeps its language, however long the text before it is."""
    model = {"langs": ["a", "b"], "pair": np.zeros((langid.SLOTS, 2), np.float32), "three": np.zeros((langid.SLOTS, 2), np.float32), "own": np.ones((len(langid.NAMES), 2), bool)}
    letters = langid.Letters(["left right"])
    pair, _ = letters.grams()
    model["pair"][pair[:4]] = [-10.0, -15.0]
    model["pair"][pair[4:]] = [-15.0, -10.0]
    both = set(pair[:4].tolist()) & set(pair[4:].tolist())
    model["pair"][list(both)] = -10.0
    body = "left " * 40 + "right " * 40
    many = 2 * langid.SLICE // len(body) + 1
    start = time.perf_counter()
    _, place, size, word = langid.labelled_words(model, [body * many])
    assert time.perf_counter() - start < 60
    assert np.array_equal(word, np.tile(np.repeat([0, 1], 40), many)) and size.sum() == many * (40 * 4 + 40 * 5)


def plain_language(model, text):
    """Language, share of letters and spans by following every language through the words one at a time."""
    words, at = [], 0
    low = text.lower()
    while at < len(low):
        end = at
        while end < len(low) and low[end].isalpha():
            end += 1
        if end > at:
            words.append((at, low[at:end]))
        at = max(end, at + 1)
    langs = range(len(model["langs"]))
    best, back = None, []
    for _, w in words:
        letters = langid.Letters([w])
        pair, three = letters.grams()
        own = [sum(bool(model["own"][s, k]) for s in letters.scripts()) * 2 > len(w) for k in langs]
        score = [float(model["pair"][pair, k].sum() + model["three"][three, k].sum()) - (0 if own[k] or not any(own) else 1e6) for k in langs]
        came = [max(langs, key=lambda j: (best[j] - (langid.SWITCH if j != k else 0), j == k)) for k in langs] if best else [0] * len(langs)  # noqa: B023
        best = [(best[came[k]] - (langid.SWITCH if came[k] != k else 0) if best else 0) + score[k] for k in langs]
        back.append(came)
    path = [int(np.argmax(best))] if words else []
    for came in reversed(back[1:]):
        path.append(came[path[-1]])
    path.reverse()
    mass = [sum(len(w) for (_, w), k in zip(words, path) if k == lang) for lang in langs]
    spans = []
    for (at, w), k in zip(words, path):
        if spans and spans[-1][0] == model["langs"][k]:
            spans[-1][2] = at + len(w)
        else:
            spans.append([model["langs"][k], at, at + len(w)])
    return (model["langs"][int(np.argmax(mass))], max(mass) / sum(mass), spans) if words else ("und", 0.0, [])


def test_language_query_equals_plain_python(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    odd = [(-1, None, "en"), (-2, "", None), (-3, "12 !?", "en"), (-4, "the and of that with this. Der und die nicht mit dem sich", None), (-5, "мир Größe aмир 世界 x", None)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    model = langid.fit(langid.labelled_sample(docs, ~langid.held_out()))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in langid.op6(docs).collect():
        lang, share, spans = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(share) and [list(s) for s in r.spans] == spans
    text = texts[-4] * 40
    whole = langid.labelled_words(model, [text])
    monkeypatch.setattr(langid, "SLICE", 50)
    assert all(np.array_equal(a, b) for a, b in zip(whole, langid.labelled_words(model, [text])))


def test_spans_of_mixed_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(langid.labelled_sample(docs, F.lit(True)))
    df = spark.createDataFrame([(1, "the and of that with this for. Der und die nicht mit dem sich von zu.")], "doc_id long, text string")
    spans = langid.identify(df, model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"]


def test_media_round_trip():
    for text in (b"", b"x" * 192, "héllo wörld ".encode() * 700):
        row = audio.described(text)
        payload = audio.from_wav(row["media"])
        assert payload.rstrip(b" ") == text.rstrip(b" ") and len(payload) % 192 == 0 and len(payload) > 0
        t = audio.from_arrow(row["log_mel"])
        assert t.column("log_mel").chunk(0).to_numpy_ndarray().shape[1:] == (64, 20)
        assert t["start_ms"].to_pylist()[0] == 0 and all(a < b for a, b in zip(t["start_ms"].to_pylist(), t["end_ms"].to_pylist()))


def plain_log_mel(payload):
    """Decibels by the formulas, a sample, a frame and a filter at a time."""
    x = [(b - 128) / 128 for b in payload]
    taps = audio.PHASES
    frames = max(1, -(-(-(-len(x) * 3 // 4) - 256) // 128) + 1)
    y = []
    for k in range((frames - 1) * 128 + 256):  # silence after the end
        whole, phase = divmod(k, 3)
        y.append(sum(taps[j, phase] * x[i] for j in range(len(taps)) if 0 <= (i := whole * 4 - audio.HALF + j) < len(x)))
    out = np.empty((frames, 20))
    for f in range(frames):
        part = np.array(y[f * 128 : f * 128 + 256]) * [0.5 - 0.5 * np.cos(2 * np.pi * i / 256) for i in range(256)]
        wave = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
        out[f] = 10 * np.log10(np.maximum(np.abs(wave @ part) ** 2 @ audio.FILTERS, 1e-10))
    return out


def test_media_query_equals_plain_python(spark):
    texts = [None, "", "short", "héllo wörld мир " * 40, "a" * 192, "x" * 193 + " tail  ", "LOUD !!!! ~~~~ " * 30 + "." * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in audio.op8(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        pad = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        whole = audio.described(raw)
        assert r.media_bytes == 44 + len(pad) and whole["media"][44:] == pad and r.media_sha256 == hashlib.sha256(whole["media"]).hexdigest()
        values, spans = audio.read_back(whole["log_mel"])
        mel = plain_log_mel(pad)
        assert np.allclose(values.reshape(-1, 20)[: len(mel)], mel, atol=1e-3) and (values.reshape(-1, 20)[len(mel) :] == audio.FLOOR_DB).all()
        assert spans[0][0] == 0 and spans[-1][1] == audio.milliseconds(len(mel)) and (spans[1:, 0] == spans[:-1, 1]).all()
        assert r.tensor_bytes == len(whole["log_mel"]) and r.feature.startswith(f"{len(values)}x64x20;{len(r.segments)};")


def test_long_media_equal_one_piece(monkeypatch):
    text = bytes(random.Random(3).randrange(32, 127) for _ in range(60_000))
    blocks_ = audio.described(text)
    monkeypatch.setattr(audio, "BLOCK", 7)
    assert audio.described(text) == blocks_


def test_resampling_and_segments():
    t = np.arange(32000)
    keep = 60 / 128 * np.sin(2 * np.pi * 1000 * np.arange(24000) / 12000)
    got = audio.resampled(128 + 60 * np.sin(2 * np.pi * 1000 * t / 16000), 0, 24000)
    assert np.abs(got - keep)[100:-100].max() < 0.01
    assert np.abs(audio.resampled(128 + 128 * np.sin(2 * np.pi * 7500 * t / 16000), 0, 24000))[100:-100].max() < 0.02
    mel = np.repeat([0, 0, 0, 0, 2.0, 1.0, 0.8, 0.2, 0, 1.0, 0], 1)[:, None] * np.ones(20)
    assert audio.active(mel - np.median(mel[:, 0])) == [(4, 7)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\abn\n>im_endstar", max_size=40), st.text(alphabet="<|\\n\na", max_size=12))
def test_chat_escapes_are_undone(text, role):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)


def test_chat_texts_spans_and_odd_rows(spark):
    rows = [(1, 1, "assistant", "b<|x"), (1, 0, "user", None), (1, 2, "assistant", "c"), (None, 0, None, "n"), (2, 5, "a\nb\\", "t"), (2, 5, "a\nb\\", "t")]
    got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, None} and got[2]["n_turns"] == 2 and got[1]["loss_chars"] == 5
    text = got[1]["formatted"]
    assert text == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nb<\\|x<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [text[s["start"] : s["end"]] for s in got[1]["loss_spans"]] == ["b<\\|x", "c"] and len(text) == got[1]["formatted_chars"]
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_of_long_texts_long_conversations_and_clashing_columns(spark):
    long = "<|im_end|> é\\ " * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), *[(2, t, "assistant" if t % 2 else "user", f"turn {t} <|im_start|>") for t in range(5000)], (3, 0, "assistant", ""), (3, None, "user", "first")]
    names = ("key", "n_turns", "formatted", "loss_spans", "turns_sha256")
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("caller's") for c in names}).repartition(5)
    got = {r["conv_id"]: r for r in chat.formatted(d).collect()}
    for conv in (1, 2, 3):
        turns = sorted(((-1 if t is None else t, r, x) for c, t, r, x in rows if c == conv))
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["loss_chars"] == len(said) and got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["formatted_chars"] == len(got[conv]["formatted"])


def test_templates():
    run = lambda s, **v: "".join(t for t, _ in template.compiled(s, {"upper": str.upper})(v))
    assert run("{% for m in xs %}{{ loop.index }}{% if loop.last %}!{% else %},{% endif %}{% endfor %}", xs=[1, 2]) == "1,2!"
    assert run("{% if a == 'x' and not b %}y{% elif a %}z{% else %}n{% endif %}", a="x", b=False) == "y"
    tree = template.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}no{% else %}d{% endif %}", {"upper": str.upper})
    assert [(n.kind, n.value) for n in tree.parts] == [("text", "abCd")]
    assert run("{{ a.__class__ }}{{ a.b }}", a={"b": 1}) == "1"
    for bad in ("{{ a | eval }}", "{% for x %}", "{% if a %}", "{{ a( }}", "{% endif %}", "{{ }}"):
        with pytest.raises(template.TemplateError):
            template.parse(bad, {})


def test_blocks():
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><!-- x --><article><h1>A &amp; B</h1><p><b>one<br>  two<p>three &lt;i&gt; 2 < 3</article><script>if (a<b) "</p>"</script><footer>&copy; x</footer><p'
    assert [b.text for b in blocks.blocks_of(page)] == ["Home", "A & B", "one two", "three <i> 2 < 3", "© x"]
    assert blocks.blocks_of("") == [] and [b.text for b in blocks.blocks_of("plain &am text")] == ["plain &am text"]


#: Pages and the lines that are in them, whatever is broken.
BROKEN = [
    ("<p>one</p><script>x()</script foo><p>two</p>", ["one", "two"]),
    ("<p>one</p><script>x()</script/><p>two</p>", ["one", "two"]),
    ("<p>one</p><SCRIPT>x('</scripted>')</Script\n x='1'><p>two</p>", ["one", "two"]),
    ("<p>one</p><script>x()<p>two</p>", ["one"]),
    ("<p>one</p><style>a{}</style\t><p>two</p>", ["one", "two"]),
    ("<p>one</p><!--><p>two</p>--><p>three</p>", ["one", "two", "-->", "three"]),
    ("<p>one</p><!---><p>two</p>", ["one", "two"]),
    ("<p>one</p><!----><p>two</p>", ["one", "two"]),
    ("<p>one</p><!-- a --!><p>two</p>", ["one", "two"]),
    ("<p>one</p><!-- a > b --><p>two</p>", ["one", "two"]),
    ("<p>one</p><iframe src=x><p>two</p><div>three</div>", ["one", "two", "three"]),
    ("<p>one</p><iframe src=x>no frames</iframe><p>two</p>", ["one", "two"]),
    ("<p>one <iframe src=x></iframe>two</p>", ["one two"]),
    ("<div><select><option>a<option>b</div><p>two</p><select><option>c</select>", ["two"]),
    ("<div>one</div><select><option>a<option>b<p>two</p>", ["one", "two"]),
    ("<p>one <select><option>a</option><option>b</option></select> two</p>", ["one two"]),
    ("<p>one</p><object data=x><p>no plug-in</p></object><p>two</p>", ["one", "two"]),
    ("<p>one</p><object data=x><p>two</p>", ["one", "two"]),
    ("<p>one</p><textarea>form<p>two</p>", ["one", "two"]),
    ("<title>head<body><p>two</p>", ["two"]),
    ("<title>a <b>head</b></title ><p>two</p>", ["two"]),
    ("<p>one</p><video><source src=x><p>none</video><p>two</p></iframe><p>three</p>", ["one", "two", "three"]),
    ("<template><div><p>x</p></div></template><p>two <a href=x>link</a></p>", ["two link"]),
    ("<p>one</p><video><audio>x</video>y</audio><p>two</p>", ["one", "y", "two"]),
]


@pytest.mark.parametrize("page, lines", BROKEN)
def test_nothing_is_lost_behind_broken_markup(page, lines):
    assert [b.text for b in blocks.blocks_of(page)] == lines


def test_many_unclosed_elements_take_linear_time():
    page = "<iframe><div>x</div><select><option>" * 40_000
    start = time.perf_counter()
    assert len(blocks.blocks_of(page)) == 40_000
    assert time.perf_counter() - start < 20


def test_labeller_on_unseen_layouts():
    model, reader, rng = labeller.trained(), labeller.Reader(), np.random.default_rng(77)
    right = total = 0
    for _ in range(120):
        page, truth = labeller.generated(rng)
        read = blocks.blocks_of(page)
        assert len(read) == len(truth)
        right += ((labeller.logits(model, reader.read([read])) > 0) == np.array(truth)).sum()
        total += len(truth)
    assert right / total > 0.98


def test_labeller_fits_a_few_pages():
    rng = np.random.default_rng(1)
    made = [labeller.generated(rng) for _ in range(4)]
    pages, truth = [blocks.blocks_of(p) for p, _ in made], [y for _, y in made]
    x, y = labeller.Reader().read(pages), np.array([t for p in truth for t in p], float)
    model = labeller.new_model()
    loss = lambda m: float(np.logaddexp(0, np.where(y == 1, -1, 1) * labeller.logits(m, x)).mean())
    before = loss(model)
    assert loss(labeller.learn(pages, truth, rounds=60)) < before / 4


ARTICLE = "The river rose over night and reached the lower streets before the bridge was closed to all traffic."
SECOND = "Nobody was hurt, but the mill and two shops stood under water until the evening of the next day."
THIRD = "Engineers said that the old dam had held and that the pumps would run for another week."
#: Body of a page, and the blocks of main text that a reader would copy out of it, written by hand.
PAGES = [
    (f"<article><h1>Flood</h1><p>{ARTICLE}</p><p>{SECOND}</p></article>", ["Flood", ARTICLE, SECOND]),
    (f"<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><p>{ARTICLE}</p><p>{SECOND}</p></article>", [ARTICLE, SECOND]),
    (f"<header>Daily Post</header><main><h1>Flood</h1><p>{ARTICLE}</p></main><footer>Copyright, all rights reserved</footer>", ["Flood", ARTICLE]),
    (f"<div class=content><p>{ARTICLE}</p><p>{SECOND}</p></div><aside class=sidebar><p>Related</p><a href=/x>More floods</a></aside>", [ARTICLE, SECOND]),
    (f"<div class='cookie-banner'><p>We use cookies. Accept all?</p></div><article><p>{ARTICLE}</p><p>{THIRD}</p></article>", [ARTICLE, THIRD]),
    (f"<article><p>{ARTICLE}</p><div class=advert>Buy boats now</div><p>{SECOND}</p></article>", [ARTICLE, SECOND]),
    (f"<article><p>{ARTICLE}</p><p>{SECOND}</p></article><form class=newsletter><p>Subscribe</p><p>Email</p></form>", [ARTICLE, SECOND]),
    (f"<article><p>{ARTICLE}</p></article><section class=comments><p>Ann says: stay dry</p><p>Reply</p></section>", [ARTICLE]),
    (f"<script>var a = '<p>x</p>';</script><style>p{{}}</style><article><p>{ARTICLE}</p><p>{SECOND}</p></article>", [ARTICLE, SECOND]),
    ("<article><p>Fish &amp; chips cost &pound;5 &#8211; or &#x35; &euro; at the &quot;Old Mill&quot; until the water came up the road.</p></article>", ['Fish & chips cost \xa35 \u2013 or 5 \u20ac at the "Old Mill" until the water came up the road.']),
    (f"<article><p>  The river\n\t rose   over night and reached <b>the lower</b> streets before the bridge was closed to all <i>traffic</i>. </p><p>{THIRD}</p></article>", [ARTICLE, THIRD]),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given and let the water rise by that much in each of the hours.</p></article>", ["Let x=2 be given and let the water rise by that much in each of the hours."]),
    (f"<article><p>{ARTICLE} <svg><title>Icon</title><text>Level 7</text></svg></p><p>{SECOND}</p></article>", [ARTICLE + " Level 7", SECOND]),
    (f'<article><p class="x>{ARTICLE}</p><p>{SECOND}</p></article>', [ARTICLE, SECOND]),
    (f"<noscript>Please enable JavaScript in your browser settings.</noscript><article><p>{ARTICLE}</p><p>{SECOND}</p></article>", [ARTICLE, SECOND]),
    (f"<article><p>{ARTICLE}<p>{SECOND}<p>{THIRD}</article>", [ARTICLE, SECOND, THIRD]),
    (f"<article><h2>Damage</h2><ul><li>{SECOND}</li><li>{THIRD}</li></ul></article>", ["Damage", SECOND, THIRD]),
    (f"<article><table><tr><td>{ARTICLE}</td><td>{SECOND}</td></tr></table></article>", [ARTICLE, SECOND]),
    (f"<article><p>{ARTICLE}<br>{SECOND}</p><!-- <p>hidden</p> --></article>", [ARTICLE + " " + SECOND]),
    (f"<article><blockquote>{THIRD}</blockquote><pre>level  7\nlevel  8 at the gauge of the lower bridge, read by hand.</pre></article>", [THIRD, "level 7 level 8 at the gauge of the lower bridge, read by hand."]),
    ("<nav><a href=/>Home</a> <a href=/a>About</a></nav><footer>Imprint</footer>", []),
    (f"<article><p>{ARTICLE}</p><p>{SECOND}</p></article><p>", [ARTICLE, SECOND]),
]


def test_pages_written_by_hand(spark):
    rows = [(i, f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>") for i, (body, _) in enumerate(PAGES)]
    out = {r.page_id: r for r in html_text.op1(spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert out[i].text.split("\n") == (want or [""]), i
        assert out[i].n_chars == len(out[i].text)


def test_block_labeller_equals_a_plain_loop():
    """Gates, cells and both directions, one block and one number at a time."""
    rng = np.random.default_rng(9)
    model, reader = labeller.new_model(seed=4), labeller.Reader()
    pages = [blocks.blocks_of(labeller.generated(rng)[0])[:n] for n in (6, 1, 9)]
    x = reader.read(pages)
    flat, got, at = labeller.inputs(model, x), labeller.logits(model, x), 0
    sigma = lambda v: 1 / (1 + np.exp(-v))
    for page in pages:
        rows = flat[at : at + len(page)]
        want = np.full(len(page), model["bias"][0])
        for way, order, out in (("f", range(len(page)), model["out"][: labeller.HIDDEN, 0]), ("b", range(len(page) - 1, -1, -1), model["out"][labeller.HIDDEN :, 0])):
            h, c = [0.0] * labeller.HIDDEN, [0.0] * labeller.HIDDEN
            for k in order:
                a = [sum(rows[k][i] * model[f"W{way}"][i][j] for i in range(rows.shape[1])) + sum(h[i] * model[f"U{way}"][i][j] for i in range(labeller.HIDDEN)) + model[f"c{way}"][j] for j in range(4 * labeller.HIDDEN)]
                gate = [a[g * labeller.HIDDEN : (g + 1) * labeller.HIDDEN] for g in range(4)]
                c = [sigma(f) * old + sigma(i) * np.tanh(g) for i, f, g, old in zip(gate[0], gate[1], gate[3], c)]
                h = [sigma(o) * np.tanh(new) for o, new in zip(gate[2], c)]
                want[k] += sum(v * w for v, w in zip(h, out))
        assert np.allclose(got[at : at + len(page)], want, atol=1e-9)
        at += len(page)


def test_long_pages_are_read_in_stretches(monkeypatch):
    rng = np.random.default_rng(5)
    model, reader = labeller.new_model(), labeller.Reader()
    page = [b for _ in range(9) for b in blocks.blocks_of(labeller.generated(rng)[0])]
    whole = labeller.logits(model, reader.read([page]))
    monkeypatch.setattr(labeller, "STRETCH", 7)
    assert np.allclose(labeller.labelled(model, reader, [page[:5], page, []]), np.concatenate((labeller.logits(model, reader.read([page[:5]])), whole)))


def test_pages_of_the_corpus(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = QUERIES["op1_html_main_text"](spark, sf_dir).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(got) == pages.count()
    for r in got:
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == "\n".join(b.text for b in blocks.blocks_of(inside)) and r["n_chars"] == len(r["text"])
