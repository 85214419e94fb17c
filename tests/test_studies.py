"""Folds, refits, draws, batches, tree hashes, strict documents, caches and arriving files against plain versions."""

import hashlib
import json
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import strict
from plumbline.operators import draws, expect, fits, folds, merkle, ranks, sensitivity, splits
from plumbline.sources import cache, sinks
from plumbline.streaming import scoring


def hashed(text):
    return int(hashlib.sha1(text.encode()).hexdigest()[:16], 16) / 18446744073709551616


# folds


def plain_folds(rows, k, seed):
    """One group after the other, to the least full fold that has not had one of its kind in this round."""
    classes = sorted({y for _, y in rows})
    counts = defaultdict(Counter)
    for g, y in rows:
        counts[g][y] += 1
    kind = {g: tuple(c[y] for y in classes) for g, c in counts.items()}
    total = [sum(n[c] for n in kind.values()) for c in range(len(classes))]
    have = [[0] * len(classes) for _ in range(k)]
    out = {}
    members = defaultdict(list)
    for g, n in kind.items():
        members[n].append(g)
    for n in sorted(members, key=lambda n: (min(n) - max(n), -sum(n), n)):
        own = sorted(members[n], key=lambda g: (hashed(f"{seed}:{g}"), g))
        whole = len(own) - len(own) % k
        for i in range(whole):
            out[own[i]] = i % k
            have[i % k] = [a + b for a, b in zip(have[i % k], n)]
        served = set()
        for g in own[whole:]:
            # Exact shares: squared shares of all folds after this group would go to fold f.
            def after(f):
                return sum(((have[f][c] + n[c]) ** 2 - have[f][c] ** 2) * math.prod(t * t for i, t in enumerate(total) if i != c) for c in range(len(classes)))  # noqa: B023

            at = min((f for f in range(k) if f not in served), key=lambda f: (after(f), sum(have[f]), f))
            served.add(at)
            out[g] = at
            have[at] = [a + b for a, b in zip(have[at], n)]
    return out


@pytest.mark.parametrize("classes", [1, 2, 3])
def test_folds_equal_a_plain_greedy(spark, classes):
    rng = np.random.default_rng(classes)
    rows = [(f"g{g}", int(y)) for g in range(150) for y in rng.integers(0, classes, rng.integers(1, 5) if g % 3 else 1)]
    rows += [("big", int(y)) for y in rng.integers(0, classes, 60)]
    frame = spark.createDataFrame([*rows, (None, 0), ("nolabel", None)], "g string, y int")
    got = {r["g"]: r["fold"] for r in splits.grouped_folds(frame, "g", "y", 4, 9).collect()}
    assert got == plain_folds(rows, 4, 9)
    sizes = Counter(got[g] for g, _ in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 60


def test_folds_with_rounded_counts(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(f"g{g}", int(y)) for g in range(200) for y in rng.integers(0, 2, rng.integers(1, 40))]
    frame = spark.createDataFrame(rows, "g string, y int")
    monkeypatch.setattr(splits, "KINDS", 40)
    got = {r["g"]: r["fold"] for r in splits.grouped_folds(frame, "g", "y").collect()}
    assert set(got) == {g for g, _ in rows} and set(got.values()) == set(range(5))
    share = Counter((got[g], y) for g, y in rows)
    for y in (0, 1):
        own = [share[f, y] for f in range(5)]
        assert max(own) < 1.35 * min(own)
    monkeypatch.setattr(splits, "KINDS", 1)
    with pytest.raises(ValueError, match="kinds"):
        splits.grouped_folds(frame, "g", "y")
    assert splits.grouped_folds(frame.filter("false"), "g", "y").count() == 0


# refits and weights


def test_refits_equal_models_fitted_one_by_one(spark):
    rng = np.random.default_rng(1)
    n, names = 400, ["a", "b", "c", "d"]
    x = rng.normal(size=(n, 4)) * [1, 2, 0.5, 1] + [0, 1, 5, 0]
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=n) > 0).astype(float)
    known, fold, source = rng.random(n) < 0.8, rng.integers(0, 3, n), rng.integers(0, 4, n)
    rows = [(i, float(y[i]) if known[i] else None, f"f{fold[i]}", int(source[i]), *map(float, x[i])) for i in range(n)]
    frame = spark.createDataFrame([*rows, (-1, 1.0, "f0", 0, None, 0.0, 0.0, 0.0)], "id long, y double, fold string, source int, a double, b double, c double, d double").repartition(3)
    variants = [sensitivity.Variant("all"), sensitivity.Variant("no family", frozenset({"a", "c"})), sensitivity.Variant("no source", without=F.col("source") == 2)]
    made, _ = sensitivity.refits(frame, names, "y", "fold", "id", variants)
    got = {(r["key"], r["variant"]): r["logit"] for r in made.collect()}
    want = {}
    for name, at, use in (("all", [0, 1, 2, 3], np.ones(n, bool)), ("no family", [1, 3], np.ones(n, bool)), ("no source", [0, 1, 2, 3], source != 2)):
        for f in (0, 1, 2, None):
            fit = known & use & ((fold != f) if f is not None else True)
            mean, sd = x[fit][:, at].mean(axis=0), x[fit][:, at].std(axis=0)
            w, b = folds.logistic((x[fit][:, at] - mean) / sd, y[fit])
            own = ~known if f is None else known & use & (fold == f)
            for i in np.flatnonzero(own):
                want[int(i), name] = float((x[i, at] - mean) / sd @ w + b)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    study = {r["variant"]: r for r in sensitivity.study(frame, names, "y", "fold", "id", variants[1:]).collect()}
    assert study["without top"]["dropped"] == "a" and study["without top"]["auc"] < study["all"]["auc"] - 0.1
    assert study["no source"]["n"] == int((known & (source != 2)).sum()) and 0 <= study["all"]["share"] <= 1
    judged = [want[int(i), "all"] for i in np.flatnonzero(~known)]
    assert study["all"]["q"] == pytest.approx(np.mean([v > 0 for v in judged])) and study["all"]["mean_p"] == pytest.approx(np.mean([1 / (1 + math.exp(-v)) for v in judged]), abs=1e-6)


def test_stacker_equals_plain_newton(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    x = np.stack([rng.normal(size=300) + y, rng.normal(size=300) * 3 + 2 * y, rng.normal(size=300) - 0.8 * y], axis=1)
    use = rng.random(300) < 0.8
    frame = spark.createDataFrame([(*map(float, r), int(k), bool(u)) for r, k, u in zip(x, y, use)] + [(float("nan"), 0.0, 0.0, 1, True)], "a double, b double, c double, y int, use boolean")
    got = {r["name"]: r for r in fits.stacker(frame, ["a", "b", "c"], "use").collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w, _ = folds.logistic(z[use], y[use].astype(float))
    assert [got[k]["coefficient"] for k in "abc"] == pytest.approx(w, abs=1e-6)
    cut = np.maximum(w, 0)
    assert [got[k]["weight"] for k in "abc"] == pytest.approx(0.5 * cut / cut.sum() + 1 / 6, abs=1e-6) and w[2] < 0
    one = fits.stacker(frame.filter("y = 1"), ["a", "b"], "use").collect()
    assert [(r["coefficient"], r["weight"]) for r in one] == [(None, 0.5), (None, 0.5)]


# ranks of draws


@pytest.mark.parametrize("slices", [16, 1 << 31])
def test_ranks_of_draws_equal_a_plain_bootstrap(spark, monkeypatch, slices):
    monkeypatch.setattr(ranks, "SLICE_BYTES", slices)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 25, 200).astype(float), rng.normal(size=200).round(1)
    a[:70] = 4.0  # a value that a third of the rows have
    keys = [f"r{i}" for i in range(200)]
    frame = spark.createDataFrame([*zip(keys, a.tolist(), b.tolist()), ("x", None, 1.0), ("y", 1.0, float("nan"))], "k string, a double, b double").repartition(5)
    got = {r["draw"]: r for r in ranks.spearman_draws(frame, "k", "a", "b", 40, 7).collect()}
    hashes = {r["k"]: r["h"] for r in frame.select("k", F.xxhash64("k").alias("h")).collect()}
    counts = folds.poisson_counts(np.array([hashes[k] for k in keys]).view(np.uint64), 40, 7).astype(int)
    assert len(got) == 40
    for draw in range(40):
        many = np.repeat(np.arange(200), counts[:, draw])
        ra, rb = pd.Series(a[many]).rank().to_numpy(), pd.Series(b[many]).rank().to_numpy()
        assert got[draw + 1]["n"] == len(many) and got[draw + 1]["rho"] == pytest.approx(np.corrcoef(ra, rb)[0, 1], abs=1e-9)
    flat = ranks.spearman_draws(frame.withColumn("a", F.lit(1.0)), "k", "a", "b", 5).collect()
    assert [r["rho"] for r in flat] == [None] * 5
    assert ranks.spearman_draws(frame.filter("false"), "k", "a", "b", 5).count() == 0


@pytest.mark.parametrize("slices", [16, 1 << 31])
def test_least_costs_of_draws_equal_a_plain_bootstrap(spark, monkeypatch, slices):
    monkeypatch.setattr(ranks, "SLICE_BYTES", slices)
    rng = np.random.default_rng(5)
    y, cluster = rng.integers(0, 2, 200), rng.integers(0, 15, 200)
    score = (rng.normal(size=200) + y).round(1)
    score[:60] = 0.4  # a score that many rows have
    rows = [(f"c{c}", int(k), float(s)) for c, k, s in zip(cluster, y, score)]
    frame = spark.createDataFrame([*rows, ("c1", None, 1.0), ("c2", 1, float("nan"))], "c string, y int, s double").repartition(4)
    costs = {"brief": (4.0, 1.0, 0.3), "averse": (1.0, 4.0, 0.5)}
    got = {r["draw"]: r for r in ranks.min_dcf_draws(frame, "c", "s", 40, costs, 3).collect()}
    hashes = {r["c"]: r["h"] for r in frame.select("c", F.xxhash64("c").alias("h")).distinct().collect()}
    names = sorted(hashes)
    counts = folds.poisson_counts(np.array([hashes[n] for n in names]).view(np.uint64), 40, 3)
    assert len(got) == 40
    for draw in range(40):
        w = counts[[names.index(c) for c, _, _ in rows], draw]
        pos, neg = w[y == 1].sum(), w[y == 0].sum()
        for name, (fa, miss, prior) in costs.items():
            best = min((fa * (1 - prior) * w[(y == 0) & (score >= t)].sum() / neg + miss * prior * w[(y == 1) & (score < t)].sum() / pos) / min(fa * (1 - prior), miss * prior) for t in np.unique(score))
            assert got[draw + 1][name] == pytest.approx(min(best, 1.0), abs=1e-9)
    one = ranks.min_dcf_draws(frame.filter("y = 1"), "c", "s", 3, costs).collect()
    assert [r["brief"] for r in one] == [None] * 3 and ranks.min_dcf_draws(frame.filter("false"), "c", "s", 3, costs).count() == 0


def test_twins_are_fitted_with_their_fold_and_not_read_out(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 2))
    y, fold, twin = x @ [1.0, -0.5] + rng.normal(size=120), rng.integers(0, 3, 120), rng.random(120) < 0.3
    frame = spark.createDataFrame([(*map(float, r), float(k), f"f{f}", bool(t)) for r, k, f, t in zip(x, y, fold, twin)], "a double, b double, y double, fold string, twin boolean")
    got = {r["variant"]: r for r in sensitivity.least_squares_study(frame, ["a", "b"], "y", "fold", {"all": [], "no a": ["a"]}, fit_only="twin").collect()}
    for name, at in (("all", [0, 1]), ("no a", [1])):
        errors = []
        for f in range(3):
            a = np.column_stack([np.ones(120), x[:, at]])
            b = np.linalg.lstsq(a[fold != f], y[fold != f], rcond=None)[0]
            read = (fold == f) & ~twin
            errors += ((y[read] - a[read] @ b) ** 2).tolist()
        assert got[name]["n"] == len(errors) == (~twin).sum() and got[name]["mse"] == pytest.approx(np.mean(errors), abs=1e-9)


def test_fold_file_with_a_pinned_hash(spark, tmp_path):
    from plumbline.sources import readers

    text = "path,label,generator,speaker,source,group,fold\na,spoof,g,s,c,gen:g,0\n"
    (tmp_path / "folds.csv").write_text(text)
    right = hashlib.sha256(text.encode()).hexdigest()
    assert readers.folds_csv(spark, str(tmp_path / "folds.csv"), right).first()["fold"] == "0"
    with pytest.raises(ValueError, match="pinned"):
        readers.folds_csv(spark, str(tmp_path / "folds.csv"), "0" * 64)


# draws and batches


def test_order_statistics_with_a_hot_value(spark):
    values = [5.0] * 700 + [float(v) for v in range(300)] + [None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    places = spark.range(1003).withColumnRenamed("id", "at").withColumn("x", F.lit("caller's"))
    got = {r["at"]: r["v"] for r in draws.order_statistic(places, "at", frame, "v", "v").collect()}
    ordered = sorted(v for v in values if v is not None)
    assert got == {i: ordered[i] if i < 1000 else None for i in range(1003)}


def test_plans_draw_for_each_row_whatever_part_is_read(spark):
    rows = spark.createDataFrame([(i * 3, f"p{i}") for i in range(120)], "n long, path string").repartition(4)
    lengths = spark.createDataFrame([(1.5 + i % 40,) for i in range(90)], "s double")
    plan = {r["path"]: r for r in draws.crop_plan(rows, "n", lengths, "s", 11).collect()}
    ordered = sorted(1.5 + i % 40 for i in range(90))
    for i in range(120):
        assert (plan[f"p{i}"]["row"], plan[f"p{i}"]["offset_seed"]) == (i, i + 11)
        assert plan[f"p{i}"]["crop_s"] == ordered[int(hashed(f"crop:11:{i}") * 90)]
    assert len({r["crop_s"] for r in plan.values()}) > 30
    mixed = draws.mixed_lengths(rows, "n", lengths, "s", 1).collect()
    assert all(3 <= r["seconds"] <= 14 for r in mixed)
    none = draws.mixed_lengths(rows, "n", lengths.filter("false"), "s", 1).collect()
    assert len(none) == 120 and all(3 <= r["seconds"] <= 14 for r in none)


def test_batches_by_length(spark):
    rng = np.random.default_rng(4)
    sizes = [*rng.integers(1, 3000, 500).tolist(), *[777] * 300, 0, 9000]
    frame = spark.createDataFrame([*enumerate(sizes), (-1, None)], "k long, n long").repartition(6)
    got = draws.length_batches(frame, "k", "n", 8000, 0.2).collect()
    assert sorted(r["k"] for r in got) == list(range(len(sizes)))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["batch"], r["place"])):
        by[r["batch"]].append(r)
    assert sorted(by) == list(range(len(by)))
    longest = math.inf
    for b in range(len(by)):
        own = [r["n"] for r in by[b]]
        assert [r["place"] for r in by[b]] == list(range(len(own))) and own == sorted(own, reverse=True)
        assert sum(own) < 8000 + max(own) and sum(own) >= 0.8 * max(own) * len(own)
        assert own[0] <= longest
        longest = own[-1]


@pytest.mark.parametrize("points", [10_000, 0])
def test_undominated_rows(spark, monkeypatch, points):
    from plumbline.operators import relations

    monkeypatch.setattr(relations, "POINTS", points)
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(rng.integers(0, 12, (300, 3)))] + [(900, None, 1.0, 1), (901, 0.0, 0.0, 50), (902, 0.0, 0.0, 50)]
    d = spark.createDataFrame(rows, "i long, a double, b double, c int").repartition(5)
    got = {r["i"] for r in relations.undominated(d, ["a", "b", "c"]).collect()}
    less = lambda x, y: all(p <= q for p, q in zip(x, y)) and x != y
    want = {i for i, *x in rows if None in x or not any(None not in y and less(y, x) for _, *y in rows)}
    assert got == want and {900, 901, 902} <= got


def test_pools_that_lie_apart_are_told_apart(spark, tmp_path):
    from plumbline.plans import registry

    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * 0.2 + (1.0 if i % 4 == 2 else -1.0 if i % 4 == 1 else 0.9 if i % 4 == 3 else -0.9)).tolist(), i % 4) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["label"]: r for r in registry.QUERIES["corpus_probe"](spark, str(tmp_path)).collect()}
    assert [got[k]["n"] for k in range(4)] == [100] * 4
    assert got[2]["share"] == 1 and got[1]["share"] == 0 and got[3]["share"] > 0.95 and got[0]["share"] < 0.05
    assert got[2]["mean_p"] > 0.8 > 0.2 > got[1]["mean_p"]


# whole-table checks


def test_tree_hash(spark, monkeypatch):
    rows = [(f"d/{i}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(600)]
    of = lambda r, **k: merkle.tree_hash(spark.createDataFrame(r, "p string, s string").repartition(3), "p", "s", **k).first()
    whole = of(rows)
    assert (whole["depth"], whole["n"]) == (1, 600) and of(rows[::-1])["tree"] == whole["tree"]
    key = lambda p: hashlib.sha256(p.encode()).hexdigest()
    leaves = defaultdict(list)
    for p, s in rows:
        leaves[key(p)[0]].append((key(p), f"{p}\0{s}\x001\n"))
    lines = "".join(f"{k}\0{hashlib.sha256(''.join(x for _, x in sorted(v)).encode()).hexdigest()}\n" for k, v in sorted(leaves.items()))
    assert whole["tree"] == hashlib.sha256(lines.encode()).hexdigest()
    changed = [*rows[:-1], (rows[-1][0], "0" * 64)]
    assert len({whole["tree"], of(changed)["tree"], of(rows[:-1])["tree"], of([*rows, rows[0]])["tree"], of([*rows, (None, None)])["tree"]}) == 5
    assert of([("a", "b")], depth=0)["tree"] == hashlib.sha256(b"a\0b\x001\n").hexdigest()
    empty = merkle.tree_hash(spark.createDataFrame([], "p string, s string"), "p", "s").first()
    assert (empty["n"], empty["tree"]) == (0, hashlib.sha256(b"").hexdigest())


def test_bundles_hold_what_was_given(spark, tmp_path):
    import io
    import wave

    rows = [(f"r{i}", bytearray(np.random.default_rng(i).integers(0, 256, 2 * i).astype(np.uint8).tobytes())) for i in range(1, 30)]
    d = spark.createDataFrame([*rows, ("empty", bytearray())], "id string, samples binary").repartition(3)
    path = str(tmp_path / "bundle")
    tree = sinks.bundle(d, path)
    assert tree == json.loads(spark.read.text(f"{path}/meta").first()[0])["tree"] and sinks.bundle_ok(spark, path)
    for r in spark.read.parquet(f"{path}/clips").filter("id in ('r7', 'empty')").collect():
        with wave.open(io.BytesIO(bytes(r["content"]))) as w:
            assert (w.getframerate(), w.getsampwidth(), w.getnchannels(), w.getnframes()) == (16000, 2, 1, r["n_samples"])
            pcm = w.readframes(10**6)
        assert r["pcm_sha256"] == hashlib.sha256(pcm).hexdigest() and pcm == (bytes(rows[6][1]) if r["id"] == "r7" else b"")
    assert sinks.bundle(d.orderBy(F.desc("id")), str(tmp_path / "again")) == tree
    with pytest.raises(FileExistsError):
        sinks.bundle(d, path)
    for bad in (d.union(d), d.withColumn("samples", F.lit(b"abc")), d.withColumn("id", F.lit(None).cast("string"))):
        with pytest.raises(sinks.Refused):
            sinks.bundle(bad, str(tmp_path / "bad"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["again", "bundle"]
    changed = spark.read.parquet(f"{path}/clips").withColumn("content", F.when(F.col("id") == "r3", F.concat(F.substring("content", 1, 44), F.lit(b"123456"))).otherwise(F.col("content")))
    changed.write.parquet(f"{path}/other")
    (tmp_path / "bundle" / "clips").rename(tmp_path / "old")
    (tmp_path / "bundle" / "other").rename(tmp_path / "bundle" / "clips")
    assert not sinks.bundle_ok(spark, path)


def test_running_sums_keep_a_callers_working_names(spark):
    from plumbline.functions.prefix import following, running

    names = ("_part", "__part", "_head", "_own", "_next", "part")
    d = spark.createDataFrame([(f"g{i % 2}", float(i * 37 % 101), i) for i in range(101)], "g string, o double, v int").withColumns({c: F.lit(c) for c in names})
    for f in (running, following):
        out = f(d, ["g"], "o", ["v"])
        assert set(out.columns) == {*d.columns, "run_v" if f is running else "next_v"} and all(r[c] == c for r in out.collect() for c in names)
    got = {r["o"]: r["run_v"] for r in running(d, ["g"], "o", ["v"]).collect()}
    rows = [(f"g{i % 2}", float(i * 37 % 101), i) for i in range(101)]
    assert got == {o: sum(w for h, p, w in rows if h == g and p <= o) for g, o, _ in rows}


def test_quantiles_of_groups(spark):
    from plumbline.functions.prefix import group_quantiles

    rng = np.random.default_rng(1)
    rows = [(None if i % 4 == 0 else f"g{i % 4}", float(v)) for i, v in enumerate(rng.integers(0, 30, 400))] + [("g1", 5.0)] * 500 + [("none", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in group_quantiles(d, ["g"], "v", {"q": 0.37, "m": 0.5}).collect()}
    assert set(got) == {None, "g1", "g2", "g3"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert r["n"] == len(own) and (r["q"], r["m"]) == pytest.approx(tuple(np.quantile(own, [0.37, 0.5])))


def test_strict_json_at_every_depth(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    schema = "id long, x double, f float, deep struct<a:array<struct<v:double,w:string>>,m:map<string,array<double>>>, plain array<int>, `odd name` double"
    rows = [(1, nan, inf, ([(nan, "p"), None, (1.5, None)], {"k": [inf, 2.0], "n": None}), [1, None], -inf), (2, 0.5, 1.0, None, None, 3.0)]
    d = spark.createDataFrame(rows, schema)
    texts = [r[0] for r in d.orderBy("id").select(strict.strict_json(d)).collect()]
    one, two = (json.loads(t, parse_constant=lambda c: pytest.fail(c)) for t in texts)
    assert one == {"id": 1, "x": None, "f": None, "deep": {"a": [{"v": None, "w": "p"}, None, {"v": 1.5, "w": None}], "m": {"k": [None, 2.0], "n": None}}, "plain": [1, None], "odd name": None}
    assert two == {"id": 2, "x": 0.5, "f": 1.0, "deep": None, "plain": None, "odd name": 3.0}
    sinks.documents(d, str(tmp_path / "docs"), "abc")
    back = [json.loads(r["value"], parse_constant=lambda c: pytest.fail(c)) for r in spark.read.text(str(tmp_path / "docs" / "identity=abc")).collect()]
    assert sorted(b["id"] for b in back) == [1, 2]


def test_twin_set(spark):
    e = lambda *v: list(v)
    wanted = spark.createDataFrame([(i,) for i in range(10)], "r long")
    nan = float("nan")
    stored = [(0, e(1.0, 2.0)), (1, e(1.0, nan)), (2, e(1.0, 2.0)), (2, e(1.0, 2.0)), (4, e(1.0, 2.0)), (5, e(1.0, 3.0)), (6, e(1.0, 2.0)), (7, None), (8, e()), (99, e(1.0, 2.0)), (None, e(1.0)), (9, e(1.0, None))]
    twin = [(0, e(1.0, 2.0)), (1, e(1.0, nan)), (2, e(1.0, 2.0)), (5, e(1.0, 2.0)), (6, e(1.0)), (8, e()), (3, e(1.0)), (77, e(1.0))]
    frame = lambda rows: spark.createDataFrame(rows, "r long, v array<double>")
    got = {r["row"]: (r["problem"], r["element"]) for r in expect.twin_set(wanted, frame(stored), frame(twin), "r", "v").collect()}
    assert got == {1: ("not finite", 1), 2: ("repeated", None), 3: ("missing", None), 4: ("twin missing", None), 5: ("differs", 1), 6: ("width", None), 7: ("not finite", None), 9: ("not finite", 1), 99: ("extra", None), None: ("extra", None)}


# caches


def test_cache_identity(spark, tmp_path):
    path, made = f"file://{tmp_path}/cache", []

    def make():
        made.append(1)
        return spark.range(5)

    first, second = {"model": "a", "n": 1}, {"n": 2, "model": "a"}
    assert cache.opened(spark, path, first) == ("new", None)
    assert cache.cached(spark, path, first, make).count() == 5 and cache.cached(spark, path, dict(reversed(first.items())), make).count() == 5
    assert len(made) == 1
    state, aside = cache.opened(spark, path, second)
    assert state == "moved" and spark.read.parquet(f"{aside}/rows").count() == 5
    assert cache.cached(spark, path, second, make).count() == 5 and len(made) == 2
    stale = lambda identity: f"{path}.stale-" + hashlib.sha256(cache.identity_text(identity).encode()).hexdigest()[:12]
    assert aside == stale(first) and cache.opened(spark, path, first) == ("moved", stale(second))
    assert cache.opened(spark, path, second) == ("moved", stale(first) + "-2")
    assert cache.opened(spark, path, second, fresh=True) == ("moved", stale(second) + "-2")


def test_cache_refuses_orphans(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "orphan" / "rows"))
    with pytest.raises(sinks.Refused, match="no _identity"):
        cache.opened(spark, str(tmp_path / "orphan"), {"a": 1})
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "_identity.json").write_text('{"a": ')
    with pytest.raises(sinks.Refused, match="no JSON"):
        cache.opened(spark, str(tmp_path / "broken"), {"a": 1})


def test_cache_after_a_crash_between_two_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    cache.cached(spark, path, {"v": 1}, lambda: spark.range(4))
    write = cache._Files.write
    monkeypatch.setattr(cache._Files, "write", lambda *_: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):  # moved aside, but the new identity was not written
        cache.opened(spark, path, {"v": 2})
    monkeypatch.setattr(cache._Files, "write", write)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["cache.stale"]
    assert cache.opened(spark, path, {"v": 2})[0] == "new"
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / "_0123.tmp").write_text("{")  # died while writing its identity
    assert cache.opened(spark, str(tmp_path / "half"), {"v": 1})[0] == "new"
    rows = tmp_path / "cache" / "rows"
    rows.mkdir()
    (rows / "part-0.parquet").write_bytes(b"half a file")  # died while writing its rows
    assert cache.cached(spark, path, {"v": 2}, lambda: spark.range(7)).count() == 7


# arriving files


def wav(samples):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_arriving_files_become_documents_once(spark, tmp_path, monkeypatch):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "a.wav").write_bytes(wav(np.sin(np.arange(8000) / 9) * 0.5))
    (inbox / "empty.wav").write_bytes(b"")
    (inbox / "bad.wav").write_bytes(b"no recording at all")

    def documents():
        return sorted((json.loads(r["value"]) for r in spark.read.text(out).collect()), key=lambda d: d["path"])

    died = []

    def judge_and_die(rows):
        scoring.judged(rows).select("path").write.mode("overwrite").text(f"{out}/batch=0")  # half of the work is there
        died.append(1)
        raise RuntimeError("executor lost")

    q = scoring.document_arrivals(spark, str(inbox), out, mark, judge_and_die)
    with pytest.raises(Exception, match="executor lost"):
        q.awaitTermination(120)
    scoring.document_arrivals(spark, str(inbox), out, mark).awaitTermination(120)
    first = documents()
    assert died and [(d["path"].rsplit("/", 1)[1], d["verdict"], d["error"]) for d in first] == [("a.wav", "decoded", None), ("bad.wav", "undetermined", "decode_error"), ("empty.wav", "undetermined", "empty")]
    assert first[0]["measured"]["n_samples"] == 8000 and first[1]["measured"] is None
    scoring.document_arrivals(spark, str(inbox), out, mark).awaitTermination(120)
    assert documents() == first
    (inbox / "b.wav").write_bytes(wav(np.zeros(100)))
    (inbox / "none.wav").write_bytes(b"")
    (inbox / "notes.txt").write_bytes(b"")
    scoring.document_arrivals(spark, str(inbox), out, mark).awaitTermination(120)
    assert [d["path"].rsplit("/", 1)[1] for d in documents()] == ["a.wav", "b.wav", "bad.wav", "empty.wav", "none.wav"]
