"""Rules that tables do not show: boundaries, golden values, missing values, readers and writers, streams."""

import json
import math
import struct
import wave

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dsp, scalars, signal
from plumbline.functions.prefix import following, quantiles
from plumbline.operators import expect, fits, folds, fusion, metrics, relations, splits
from plumbline.operators.features import dealt, decode_stats, features, perturbed
from plumbline.plans import fits as plans
from plumbline.plans import models, registry
from plumbline.sources import readers, sinks
from plumbline.streaming import scoring

#: Recorded end-to-end values: ranks in 16142ths, base, fused probability, final probability. Fixed values.
GOLDEN = [
    ((0, 2125, 70), 0.027196134308016352, 0.00019987935627022507, 0.0011996794769139549),
    ((16027, 6178, 14982), 0.8578986494858134, 0.9979336002462545, 0.9979356666460083),
    ((15305, 10581, 12776), 0.8582827406764961, 0.9979475664640605, 0.9979496188975964),
]


def test_recorded_documents(spark):
    d = spark.createDataFrame([tuple(k / 16142 for k in r) + (b, p, q) for r, b, p, q in GOLDEN], "r_s1 double, r_s2 double, r_s3 double, base double, p double, q double")
    got = d.select(fusion.blend().alias("b"), scalars.platt(F.col("base"), fusion.PLATT_A, fusion.PLATT_B, fusion.PRIOR_SHIFT).alias("pf"), scalars.determinate(F.col("p")).alias("d"), "base", "p", "q").collect()
    for r in got:
        assert r["b"] == pytest.approx(r["base"], abs=1e-15)
        assert r["pf"] == pytest.approx(r["p"], rel=1e-5)
        assert r["d"] == pytest.approx(r["q"], abs=1e-15)


def scores(spark, rows):
    return spark.createDataFrame(rows, "g string, score double, y int")


def test_perfect_and_constant_scores(spark):
    d = scores(spark, [("good", 1.0, 1), ("good", 0.0, 0), ("flat", 0.0, 1), ("flat", 0.0, 0), ("one", 1.0, 1)])
    got = {r["g"]: r["min_dcf"] for r in metrics.min_dcf(d, ["g"]).collect()}
    assert got == {"good": 0.0, "flat": 1.0, "one": None}
    assert {r["g"]: r["auc"] for r in metrics.auc(d, ["g"]).collect()} == {"good": 1.0, "flat": 0.5, "one": None}
    assert {r["g"]: r["eer"] for r in metrics.eer(d, ["g"]).collect()} == {"good": 0.0, "flat": 0.5}


def test_missing_scores_are_left_out(spark):
    d = scores(spark, [("a", 1.0, 1), ("a", None, 1), ("a", float("nan"), 0), ("a", 0.0, 0), ("a", 5.0, None)])
    assert metrics.auc(d, ["g"]).first()["auc"] == 1.0


def test_metrics_of_an_empty_table(spark):
    d = scores(spark, [])
    assert metrics.min_dcf(d, ["g"]).count() == metrics.eer(d, ["g"]).count() == metrics.spearman(d, ["g"], "score", "y").count() == 0


def test_min_dcf_equals_a_scan_of_thresholds(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.normal(size=300), 1), rng.integers(0, 2, 300)
    best = min([1.0] + [(2.8 * (s[y == 0] >= t).mean() + 0.3 * (s[y == 1] < t).mean()) / 0.3 for t in np.unique(s)])
    got = metrics.min_dcf(scores(spark, [("a", float(a), int(b)) for a, b in zip(s, y)]), ["g"]).first()["min_dcf"]
    assert got == pytest.approx(best, abs=1e-12)


def test_suppression_is_strict(spark):
    d = spark.createDataFrame([(0.5, -9.0), (0.6, -3.0), (0.6, -3.1), (0.6, None)], "base double, m double")
    assert [r[0] for r in d.select(fusion.suppressed(F.col("base"), F.col("m"))).collect()] == [0.5, 0.6, 0.3, 0.6]


def test_missing_rank_is_one_half(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "path string, s double")
    got = {r["path"]: r["r_s"] for r in fusion.ranked(d, d, ("s",)).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 0.5}


def test_policy_blocks_do_not_touch(spark):
    d = spark.createDataFrame([("a", 0.0, True, False, 0.0), ("b", 1.0, False, False, 1.0), ("c", 1.0, True, True, 1.0)], "k string, p double, ok boolean, failed boolean, s double")
    a, b, c = [r[0] for r in d.select(fusion.pinned(F.col("p"), F.col("ok"), F.col("failed"), F.col("s"), F.col("k"))).collect()]
    assert a == 0.001 and 0.0001 <= b < 0.001 and c < 0.0001


@pytest.mark.parametrize("most, few", [(fusion.RANKS, fusion.FEW), (0, 3), (0, 10**9)])
def test_ranks_of_two_detectors_with_a_hot_value(spark, monkeypatch, most, few):
    monkeypatch.setattr(fusion, "RANKS", most)
    monkeypatch.setattr(fusion, "FEW", few)
    rows = [(i, 1.0 if i % 2 else float(i % 7), None if i % 5 == 0 else float("nan") if i % 11 == 0 else 1000.0 * (i % 13)) for i in range(200)]
    d = spark.createDataFrame(rows, "i long, a double, b double")
    reference = d.filter("i < 90")
    got = {r["i"]: (r["r_a"], r["r_b"]) for r in fusion.ranked(d, reference, ("a", "b")).collect()}
    assert len(got) == 200
    for k, c in enumerate("ab"):
        ref = [r[k + 1] for r in rows[:90] if r[k + 1] is not None and r[k + 1] == r[k + 1]]
        for r in rows:
            v = r[k + 1]
            assert got[r[0]][k] == pytest.approx(0.5 if v is None or v != v else sum(x < v for x in ref) / len(ref)), (c, r)
    none = fusion.ranked(d, d.filter("false"), ("a",)).collect()
    assert {r["r_a"] for r in none} == {0.5}


def test_gate_reasons(spark):
    d = spark.createDataFrame([(-90.0,), (-20.0,)], "level double")
    got = [r[0] for r in d.select(fusion.gate_reasons(F.col("level"), F.lit(0.9), F.lit(0.0), F.lit(1.0), F.lit(0.5))).collect()]
    assert got == [["silent"], ["noise", "unvoiced", "steady"]]


def test_groups_never_straddle_folds(spark):
    d = spark.createDataFrame([(f"g{i % 13}", i % 2) for i in range(400)], "g string, y int")
    f = splits.grouped_folds(d, "g", "y")
    assert f.count() == f.select("g").distinct().count() == 13
    assert f.groupBy("fold").count().count() == 5


def test_out_of_fold_finds_the_signal(spark):
    rng = np.random.default_rng(0)
    rows = [(i, str(i % 5), int(y), float(rng.normal() + 2 * y), float(rng.normal())) for i, y in enumerate(rng.integers(0, 2, 400))]
    d = spark.createDataFrame(rows, "id long, fold string, y int, a double, b double")
    got = folds.out_of_fold(d, ["a", "b"], "id").join(d.select("id", "y"), "id").withColumnRenamed("logit", "score").withColumn("g", F.lit("x"))
    assert metrics.auc(got, ["g"]).first()["auc"] > 0.85


def test_bootstrap_draws_whole_clusters(spark):
    d = spark.createDataFrame([("a", 1.0)] * 5 + [("b", 0.0)] * 5, "c string, v double")
    got = {round(r["v"], 6) for r in folds.poisson_bootstrap(d, "c", ["v"], 50).collect() if r["v"] is not None}
    assert all(any(abs(v - k / n) < 1e-6 for n in range(1, 15) for k in range(n + 1)) for v in got) and len(got) > 3


def test_ambiguous_template_name_is_an_error(spark):
    files = spark.createDataFrame([("x/a/1",), ("y/a/1",)], "path string")
    wanted = spark.createDataFrame([("z/a/1",)], "want string")
    with pytest.raises(Exception, match="ambiguous"):
        relations.resolved(wanted, files, "want", "path").collect()


def test_violations(spark):
    d = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("b", None)], "path string, score double")
    got = {r["problem"]: r["n"] for r in expect.submission(d, "path", "score", 0.0, 1.0).collect()}
    assert got == {"duplicate": 1, "not finite": 1, "out of range": 1}


def write_wav(path, x):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


def test_recordings_and_features(spark, tmp_path):
    t = np.arange(32000) / 16000
    (tmp_path / "in" / "deep").mkdir(parents=True)
    write_wav(tmp_path / "in" / "hum.wav", 0.3 * np.sin(2 * np.pi * 50 * t))
    write_wav(tmp_path / "in" / "deep" / "tone.wav", 0.3 * np.sin(2 * np.pi * 200 * t))
    (tmp_path / "in" / "bad.wav").write_bytes(b"no recording")
    (tmp_path / "in" / "notes.txt").write_text("x")
    clips = readers.recordings(spark, str(tmp_path / "in"))
    assert {r["id"] for r in clips.select("id").collect()} == {"hum.wav", "deep/tone.wav", "bad.wav"}
    got = {(r["id"], r["family"]): r for r in features(clips, ["gate", "prosody", "cepstra"], "id").collect()}
    assert got["bad.wav", "gate"]["status"] == "decode_error" and not got["bad.wav", "gate"]["features"]
    assert got["deep/tone.wav", "prosody"]["features"]["pitch_mean"] == pytest.approx(200, abs=4)
    assert all(r["status"] == "ok" for k, r in got.items() if k[0] != "bad.wav")
    stats = {r["id"]: r for r in decode_stats(clips, "id").collect()}
    assert stats["hum.wav"]["n_samples"] == 32000 and stats["bad.wav"]["status"] == "decode_error"
    q = scoring.score_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ["gate"])
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3  # files of the folder itself


def test_gates_of_many_clips_are_those_of_each():
    rng = np.random.default_rng(0)
    t = np.arange(40000) / 16000
    xs = [rng.normal(size=n) * 0.1 for n in (1, 700, 1300, 7999, 8000, 24000)] + [0.3 * np.sin(2 * np.pi * 200 * t), np.zeros(9000), np.ones(50) * 0.3, np.empty(0)]
    each = [signal.speech_gate(x) for x in xs]
    turn = rng.permutation(len(xs))
    assert [each[i] for i in turn] == signal.speech_gates([xs[i] for i in turn])
    for x, got in zip(xs, each):  # silence behind a short clip is part of it
        assert signal.speech_gate(np.pad(x, (0, max(0, 8000 - len(x))))) == pytest.approx(got, abs=1e-9)
    assert each[6]["voiced"] > 0.9 and each[7]["level_db"] == -180.0


def test_clips_of_one_task_are_dealt(spark):
    clips = spark.range(400).select(F.concat(F.lit("doc/"), "id").alias("path"), F.lit(b"x").alias("content")).coalesce(1)
    at = [{r[0]: r[1] for r in features(dealt(clips, seed=seed), ["gate"]).select("path", F.spark_partition_id()).collect()} for seed in (1, 2)]
    assert all(len(a) == 400 and len(set(a.values())) > 8 for a in at) and at[0] != at[1]


@pytest.fixture
def odd_dir(spark, tmp_path):
    """Documents without text, with none or one byte of it, and several of one id."""
    rows = [(0, None), (1, ""), (2, "A"), (3, "A."), (4, "\0\0\0\0"), (5, "words " * 300), (7, "same " * 30), (7, "same " * 30), (8, "one text"), (8, "another, longer text " * 20), (9, None), (19, ""), (29, "text"), (-9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["preflight", "header_probe", "pcm_hashes"])
def test_recordings_of_odd_documents_equal_sql(spark, odd_dir, name):
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd_dir}/documents.parquet/*.parquet'")
    assert oracle.differences(registry.QUERIES[name](spark, odd_dir), con, registry.ORACLES[name]) == ""


def test_readings_that_differ_are_told(spark, odd_dir, monkeypatch):
    from plumbline.plans import studies

    def changed(*given, **more):
        again = lambda path: (F.col("clip.turn") == 2) & (F.col("clip.path") == path)
        moved = F.transform_values("features", lambda k, v: v + F.when(again("doc/3"), 1e-5).when(again("doc/4"), 1e-7).otherwise(0.0))
        return features(*given, **more).filter(~again("doc/5")).withColumn("features", moved).withColumn("status", F.when(again("doc/1"), "failed").otherwise(F.col("status")))

    monkeypatch.setattr(studies.fe, "features", changed)
    got = {r["path"]: (r["status"], r["repeats"]) for r in studies.preflight(spark, odd_dir).collect()}
    assert got["doc/1"] == got["doc/5"] == ("differs", False) and got["doc/3"] == ("ok", False) and got["doc/4"] == got["doc/0"] == ("ok", True)


def test_frames_of_a_long_clip_are_not_held_at_once(monkeypatch):
    most, pitches = [], signal._pitches
    monkeypatch.setattr(signal, "_pitches", lambda f: most.append(len(f)) or pitches(f))
    assert signal.speech_gate(np.random.default_rng(2).normal(size=160_000))["energy_std"] < 1
    assert max(most) <= signal.BLOCK < sum(most)


def test_perturbations_are_dealt_and_measured_one_by_one(spark, sf_dir, tmp_path):
    assert models.perturbations(spark, sf_dir).select(F.spark_partition_id()).distinct().count() > 8  # the table has one row group
    rng = np.random.default_rng(1)
    for n in (1, 300, 20000):
        write_wav(tmp_path / f"{n}.wav", rng.normal(size=n) * 0.2)
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    clips, kinds = readers.recordings(spark, str(tmp_path)), ["noise20", "speed", "tilt"]
    got = {(r["id"], r["kind"]): (r["features"], r["status"]) for r in perturbed(clips, "gate", kinds, "id").collect()}
    assert len(got) == 12 and got["bad.wav", "tilt"] == ({}, "decode_error")
    for n in (1, 300, 20000):
        x = dsp.decode_wav((tmp_path / f"{n}.wav").read_bytes()).astype(np.float64)
        for s, k in enumerate(kinds):
            assert got[f"{n}.wav", k] == (pytest.approx(signal.speech_gate(dsp.PERTURBATIONS[k](x, s))), "ok")


def test_clip_features_are_dealt(spark, sf_dir):
    assert models.clip_features(spark, sf_dir).select(F.spark_partition_id()).distinct().count() > 8  # the table has one row group


def test_cropped_tones_give_whole_products():
    q = 1 / (2 ** (1 / signal.CQ_STEPS) - 1)
    f = signal.CQ_LOW * 2 ** (np.arange(signal.CQ_BINS) / signal.CQ_STEPS)
    n, wide = int(np.ceil(q * 16000 / f[0])), q * 16000 / f
    at = np.arange(n)[:, None] - n / 2
    kernel = np.where(np.abs(at) <= wide / 2, 0.5 + 0.5 * np.cos(2 * np.pi * at / wide), 0) * np.exp(-2j * np.pi * at * f / 16000) / wide
    rng = np.random.default_rng(2)
    for length in (1, 300, 3000, 60000):
        clip = signal.Clip(rng.normal(size=length) * 0.1)
        rows = np.lib.stride_tricks.sliding_window_view(np.pad(clip.x, (n // 2, n - n // 2)), n)[:: signal.CQ_HOP]
        want = np.log(np.abs(rows @ kernel) ** 2 + 1e-10) @ dsp.cosines(signal.CQ_BINS, signal.CQ_KEPT).T
        assert signal.constant_q(clip) == pytest.approx(dsp.moving(want, "cqcc"), rel=1e-6, abs=1e-6)


def test_percentiles_and_slopes():
    v = np.random.default_rng(3).normal(size=(5, 37))
    assert np.allclose(signal.percentile(v, 2, 50, 100), np.percentile(v, [2, 50, 100], axis=1))
    assert np.allclose(signal._slope(np.arange(37) * 0.1, v), np.polyfit(np.arange(37) * 0.1, v.T, 1)[0])


def test_signal_functions():
    x = np.random.default_rng(0).normal(size=16000) * 0.1
    noisy = dsp.add_noise(x, 20, 1) - x
    assert 10 * np.log10((x * x).mean() / (noisy * noisy).mean()) == pytest.approx(20, abs=1e-9)
    high = np.sin(2 * np.pi * 7900 * np.arange(16000) / 16000)
    assert np.abs(dsp.band_limit(high)[500:-500]).max() < 0.02
    assert len(dsp.windows(np.arange(10.0), 4, 3)) == 3 and dsp.windows(np.arange(2.0), 4).tolist() == [[0, 1, 0, 1]]
    assert len(dsp.trim(np.concatenate([np.zeros(16000), x * 5, np.zeros(16000)]))) <= 16640


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("path,fold,split,score,logit\na,0,stress,0.5,NaN\nb,holdout,test,,1.5\n")
    got = {r["path"]: r for r in readers.export_csv(spark, str(tmp_path / "e.csv")).collect()}
    assert got["a"]["split"] == "itw" and got["a"]["logit"] is None and got["b"]["score"] is None
    (tmp_path / "p.txt").write_text("s1 u1 - - bonafide\ns2 u2 - A01 spoof\n")
    assert [r["generator"] for r in readers.protocol(spark, str(tmp_path / "p.txt")).orderBy("utt").select("generator").collect()] in (["-", "A01"], ["bonafide", "A01"])
    (tmp_path / "t.tsv").write_text("x\tfilename\n1\tb\n2\ta\n")
    t = readers.template(spark, str(tmp_path / "t.tsv"))
    assert [r["filename"] for r in t.orderBy("ord").collect()] == ["b", "a"]
    (tmp_path / "dup.tsv").write_text("filename\na\na\n")
    with pytest.raises(ValueError):
        readers.template(spark, str(tmp_path / "dup.tsv"))
    (tmp_path / "c.jsonl").write_text('{"k":"a","v":1}\n{"k":"a","v":2}\n{"k":"b"\n')
    assert [(r["k"], r["v"]) for r in readers.latest_json(spark, str(tmp_path / "c.jsonl"), "k string, v long", "k").collect()] == [("a", 2)]
    (tmp_path / "m.csv").write_text("path|label\na|x\n")
    assert readers.piped(spark, str(tmp_path / "m.csv"), "path string, label string").first()["label"] == "x"


def test_writers_refuse(spark, tmp_path):
    d = spark.createDataFrame([(1, "b", 0.25), (0, "a", 0.1)], "ord long, filename string, `cm-score` double")
    back = sinks.submission(d, str(tmp_path / "s"))
    assert {tuple(r) for r in back.collect()} == {("a", 0.1), ("b", 0.25)}
    with pytest.raises(Exception):
        sinks.submission(d, str(tmp_path / "s"))
    for bad in ([(0, "a", 0.1), (1, "a", 0.2)], [(0, "a", 1.5)], [(0, "a", float("nan"))], []):
        with pytest.raises(sinks.Refused):
            sinks.submission(spark.createDataFrame(bad, d.schema), str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_resumed_shards_and_documents(spark, tmp_path):
    d = spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("shard"))
    assert sinks.new_shards(d.filter("shard < 2"), str(tmp_path / "sh"), "id", "shard") == 20
    assert sinks.new_shards(d, str(tmp_path / "sh"), "id", "shard") == 20
    assert sinks.new_shards(d, str(tmp_path / "sh"), "id", "shard") == 0
    assert readers.shards(spark, str(tmp_path / "sh"), "id").count() == 40
    with pytest.raises(ValueError):
        d.filter("id <> 3").write.parquet(str(tmp_path / "gap"))
        readers.shards(spark, str(tmp_path / "gap"), "id")
    sinks.documents(spark.createDataFrame([("a", float("nan"))], "k string, v double"), str(tmp_path / "docs"), "abc")
    assert spark.read.text(str(tmp_path / "docs")).first()["value"] == '{"k":"a","v":null}'
    sinks.run_log(spark, str(tmp_path / "log"), rung="A", note=None)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_stream_windows_equal_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = scoring.windowed_counts(stream, late="4000 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").select("window", "event_type", "n").exceptAll(scoring.windowed_counts(events).select("window", "event_type", "n")).count() == 0


def test_wav_headers():
    body = struct.pack("<4h", 0, 16384, -16384, 0)
    head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 64000, 4, 16) + b"data" + struct.pack("<I", len(body))
    assert dsp.decode_wav(head + body).tolist() == [0.25, -0.25]
    assert dsp.decode_wav(None) is None and dsp.decode_wav(head) is None and dsp.decode_wav(b"RIFFxx") is None
    assert math.isclose(scalars.bayes_threshold(4, 1, 0.3), math.log(4) + math.log(7 / 3))


def test_recordings_of_no_samples(spark):
    head = lambda n: b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", n)
    assert dsp.read_wav(head(0)).tolist() == [] and dsp.decode_wav(head(0)) is None
    assert dsp.read_wav(head(4)) is None and dsp.read_wav(head(0) + b"\0\0") is None and dsp.read_wav(b"") is None  # cut off, of an unknown length, no file
    d = spark.createDataFrame([("none", bytearray(head(0))), ("cut", bytearray(head(4))), ("one", bytearray(head(2) + b"\0@"))], "path string, content binary")
    for empty in (False, True):
        got = {r["path"]: (r["status"], r["features"].get("level_db")) for r in features(d, ["gate"], empty=empty).collect()}
        assert got["none"] == (("ok", -180.0) if empty else ("decode_error", None)) and got["cut"] == ("decode_error", None) and got["one"][0] == "ok"


def test_header_facts_of_all_kinds_of_files(spark):
    from plumbline.functions.headers import wav_facts

    def wav(*chunks, riff=b"RIFF", name=b"WAVE"):
        body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in chunks)
        return riff + struct.pack("<I", 4 + len(body)) + name + body

    fmt = lambda rate=16000, channels=1, bits=16, kind=1: (b"fmt ", struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits))
    none = (None,) * 6
    cases = [
        (wav(fmt(), (b"data", b"\0" * 200)), ("WAV", 1, 16000, 16, 100, 0.00625, None)),
        (wav((b"LIST", b"odd"), fmt(44100, 2, 24), (b"fact", b"1234"), (b"data", b"\0" * 601)), ("WAV", 2, 44100, 24, 100, 100 / 44100, None)),
        (wav(fmt(bits=8), (b"data", b"")), ("WAV", 1, 16000, 8, 0, 0.0, None)),
        (wav(fmt(3_000_000_000 & 0x7FFFFFFF), (b"data", b"ab")), ("WAV", 1, 3_000_000_000 & 0x7FFFFFFF, 16, 1, 1 / (3_000_000_000 & 0x7FFFFFFF), None)),
        (b"", (*none, "empty")), (None, (*none, "empty")), (b"RIFF", (*none, "no RIFF")), (b"no recording at all", (*none, "no RIFF")),
        (wav((b"data", b"\0" * 8)), (*none, "no format")), (wav((b"data", b"\0" * 8), fmt()), (*none, "no format")),
        (wav(fmt(kind=3), (b"data", b"\0" * 8)), (*none, "not PCM")), (wav(fmt(channels=0), (b"data", b"\0" * 8)), (*none, "not PCM")),
        (wav(fmt()), (*none, "no samples")), (wav(fmt(), (b"data", b"12"))[:30], (*none, "no format")),
    ]
    d = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = {r["i"]: tuple(r)[1:] for r in wav_facts(d.withColumn("rate", F.lit("caller's")), "content").collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i][:5] + got[i][6:] == want[:5] + want[6:] and got[i][5] == (want[5] if want[5] is None else pytest.approx(want[5])), (i, got[i])


def test_tags_that_name_a_tool(spark):
    rows = [({"encoder": "Lavf", "comment": "made with ElevenLabs"}, 0.9, "elevenlabs"), ({"a": "Mattsson"}, 0.5, None), ({"a": "a TTS voice"}, 0.9, "tts"), ({"tts": "none"}, 0.5, None), ({"a": "Deepfake, cloned"}, 0.75, "cloned"), ({}, 0.5, None), (None, 0.5, None), ({"a": None, "b": "ai voice"}, 0.75, "ai voice")]
    d = spark.createDataFrame(rows, "tags map<string,string>, score double, term string")
    score, term = scalars.tag_score(F.col("tags"))
    assert [(r["s"], r["t"]) for r in d.select(score.alias("s"), term.alias("t")).collect()] == [(s, t) for _, s, t in rows]


def test_probe_reads_whole_embeddings(spark, tmp_path):
    from plumbline.plans import registry

    rng = np.random.default_rng(3)
    label = np.arange(200) // 5 % 2
    x = rng.normal(size=(200, 24))
    x[:, 20] += np.where(label == 0, 4.0, -4.0)
    spark.createDataFrame([(i, r.tolist(), int(y)) for i, (r, y) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = registry.QUERIES["probe_oof"](spark, str(tmp_path)).collect()
    assert len(out) == 200 and np.mean([(r["logit"] > 0) == (label[r["vec_id"]] == 0) for r in out]) > 0.95


def test_lookups_with_repeated_turns(spark, tmp_path):
    import oracle

    from plumbline.plans import registry

    rows = [(1, 0, "user", "aaa"), (1, 0, "user", "bbbbb"), (1, 1, "assistant", "a"), (1, 1, "assistant", "bb"), (1, 1, "assistant", None), (2, 1, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("nested_lookup", "collect_logits"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        assert oracle.differences(df, con, registry.ORACLES[name]) == ""
        assert "collect_list" not in df._jdf.queryExecution().toString()


def test_submission_in_numbered_parts(spark, tmp_path):
    d = spark.range(400).select(F.col("id").alias("ord"), F.format_string("f%03d", 399 - F.col("id")).alias("filename"), (F.col("id") / 400).alias("cm-score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.submission(d, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "s").glob("part-*"))
    lines = [x.split("\t")[0] for p in parts for x in p.read_text().splitlines()[1:]]
    assert len(parts) > 1 and lines == [f"f{399 - i:03d}" for i in range(400)]


def fixtures():
    """Clips of four seconds: silence, a chord, noise, hum, a click, a step of the mean, a voice-like tone, and tiny ones."""
    t, rng = np.arange(64_000) / 16_000, np.random.default_rng(0)
    quiet = rng.normal(0, 0.01, len(t))
    click, step = quiet.copy(), quiet.copy()
    click[30_000], step[32_000:] = 0.9, step[32_000:] + 0.2
    voice = sum(np.sin(2 * np.pi * 120 * k * t) / k for k in range(1, 20)) * (1 + 0.5 * np.sin(2 * np.pi * 4 * t))
    chord = sum(0.1 * np.sin(2 * np.pi * f * t) for f in (261.6, 329.6, 392.0))
    return {"silence": 0 * t, "chord": chord, "noise": rng.normal(0, 0.1, len(t)), "hum": 0.1 * np.sin(2 * np.pi * 50 * t) + quiet, "click": click, "step": step, "voice": voice, "short": quiet[:700], "one": np.ones(1)}


SIZES = {"prosody": 75, "constant_q": 72, "rhythm": 6, "breath": 4, "cycles": 5, "high_band": 13, "channel": 7, "cepstra": 60, "gate": 5}


def test_signal_families_have_all_quantities_and_stay_finite():
    assert set(SIZES) == set(signal.FAMILIES)
    for name, x in fixtures().items():
        clip = signal.Clip(x)
        for family, n in SIZES.items():
            out, status = signal.safe(clip, family)
            assert status == "ok" and len(out) == n, (name, family, status)


def test_signal_families_see_what_is_there():
    clips = {k: signal.Clip(x) for k, x in fixtures().items()}
    of = lambda family, name: signal.FAMILIES[family](clips[name])
    assert of("prosody", "voice")["pitch_mean"] == pytest.approx(120, abs=3) and of("prosody", "voice")["voiced"] == 1
    assert of("rhythm", "voice")["mod_peak_hz"] == pytest.approx(4, abs=0.1)
    assert of("cycles", "voice")["jitter_local"] < 0.02 and of("cycles", "noise")["cycle_cover"] < 0.5
    assert of("prosody", "noise")["above_4000_mean"] == pytest.approx(0.5, abs=0.05)
    limited = signal.Clip(dsp.band_limit(fixtures()["noise"], 5000))
    assert signal.high_band(limited)["level_6500"] < -30 < of("high_band", "noise")["level_6500"]
    gate = {k: signal.speech_gate(x) for k, x in fixtures().items()}
    assert gate["silence"]["level_db"] == -180 and gate["noise"]["flatness"] > 0.9 and gate["chord"]["pitch_std"] < 0.01 and gate["voice"]["voiced"] == 1
    assert of("breath", "voice")["breath_share"] == 0 and of("channel", "silence")["loud_std"] == 0


def test_clip_preparation():
    x = np.concatenate((np.zeros(16_000), fixtures()["voice"], fixtures()["voice"], fixtures()["voice"]))
    y = signal.segment(x)
    assert len(y) == 128_000 and np.array_equal(signal.segment(x, 2, 5), signal.segment(x, 2, 5)) and len(signal.segment(x[:100])) == 100
    assert signal.deployed(x).std() == pytest.approx(1, abs=1e-3) and np.sqrt((signal.level(x) ** 2).mean()) == pytest.approx(0.1, abs=1e-6)
    assert signal.fitted(np.arange(3.0), 8, "repeat").tolist() == [0, 1, 2, 0, 1, 2, 0, 1] and signal.fitted(np.arange(3.0), 8, "whole").tolist() == [0, 1, 2, 0, 1, 2, 0, 0]
    assert signal.fitted(np.arange(3.0), 5, "zero").tolist() == [0, 1, 2, 0, 0] and signal.pre_emphasis(np.ones(3)) == pytest.approx([1, 0.03, 0.03])


def test_following_rows(spark):
    rows = [("a" if i % 3 else None, float(i * 7 % 501), i) for i in range(500)]
    out = following(spark.createDataFrame(rows, "k string, v double, n int"), ["k"], "v", ["n"]).collect()
    for key in ("a", None):
        own = sorted((r.v, r.n, r.next_n) for r in out if r.k == key)
        assert [x[2] for x in own] == [x[1] for x in own][1:] + [None]
    assert len(out) == 500


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate((rng.normal(size=501), np.repeat(0.25, 300), [-7.0, 7.0])).tolist()
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "v double")
    shares = {"lowest": 0.0, "low": 0.01, "middle": 0.5, "high": 0.937, "highest": 1.0}
    got = quantiles(df, "v", shares).collect()
    assert len(got) == 1 and got[0].asDict() == pytest.approx({n: np.quantile(values, p) for n, p in shares.items()}, abs=1e-12)
    assert quantiles(df.filter("v is null"), "v", {"m": 0.5}).collect()[0]["m"] is None
    assert quantiles(df.filter("v = 7"), "v", {"m": 0.5}).collect()[0]["m"] == 7.0


def test_platt_map_equals_a_plain_fit(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.2).astype(int)
    x = rng.normal(0, 1, 600) + y
    a, b = folds.logistic(x[:, None], y, c=1e6)
    got = fits.platt_fit(spark.createDataFrame([(float(v), int(k)) for v, k in zip(x, y)] + [(None, 1), (0.5, None)], "score double, y int")).first()
    assert (got["a"], got["b"]) == (pytest.approx(a[0], rel=1e-6), pytest.approx(b, abs=1e-6)) and got["n"] == 600
    one = [fits.platt_fit(spark.createDataFrame(r, "score double, y int")).first() for r in ([(1.0, 1)], [])]
    assert [tuple(r) for r in one] == [(None, None, 1, "one class"), (None, None, 0, "empty")]


def test_novelty_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 5)) * np.array([1, 2, 0.5, 3, 1])
    x[200:] += rng.normal(0, 2, (100, 5))
    rows = [(i, v.tolist(), i < 200) for i, v in enumerate(x)] + [(300, None, True), (301, [1.0], False), (302, [float("nan")] * 5, False)]
    d = spark.createDataFrame(rows, "id long, v array<double>, fitted boolean")
    got = {r["id"]: r["distance"] for r in fits.distances(d, "id", "v", "fitted").collect()}
    z = (x - x[:200].mean(0)) / (x[:200].std(0) + 1e-9)
    inverse = np.linalg.inv(np.cov(z[:200], rowvar=False) + 1e-3 * np.eye(5))
    want = np.array([v @ inverse @ v for v in z])
    assert np.allclose([got[i] for i in range(300)], want, rtol=1e-9) and [got[i] for i in (300, 301, 302)] == [None] * 3
    r = fits.novelty_share(d, "id", "v", "fitted").first()
    border = np.quantile(want[:200], 0.99)
    assert r["border"] == pytest.approx(border) and (r["n"], r["novelty"]) == (100, pytest.approx((want[200:] > border).mean()))
    assert fits.novelty_share(d.limit(0), "id", "v", "fitted").first()["novelty"] is None


def test_bootstrap_sums_do_not_depend_on_partitions(spark):
    rows = [(f"c{i % 7}" if i % 11 else None, float(i), None if i % 3 else float("nan")) for i in range(500)]
    d = spark.createDataFrame(rows, "c string, v double, w double")
    a, b = (folds.poisson_sums(x, "c", ["v", "w"], 60).orderBy("draw").collect() for x in (d.repartition(1), d.repartition(5)))
    assert a == b and len(a) == 60 and all(r["w"] == 0 and r["n_w"] == 0 for r in a)
    mean = [r["v"] for r in folds.poisson_bootstrap(d.select(F.monotonically_increasing_id().alias("c"), "v"), "c", ["v"], 400).collect()]
    assert np.mean(mean) == pytest.approx(249.5, abs=2) and np.std(mean) == pytest.approx(500 / 12**0.5 / 500**0.5, rel=0.15)
    counts = folds.poisson_counts(np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 20, 1)
    assert counts.mean() == pytest.approx(1, abs=0.02) and counts.var() == pytest.approx(1, abs=0.05)
    assert folds.poisson_sums(d.limit(0), "c", ["v"], 5).count() <= 5


def test_batches_keep_their_quotas(spark):
    rows = [(i, i % 2, "ab"[i % 3 == 0]) for i in range(90)] + [(90, 1, "c"), (None, 1, "a"), (91, None, "a"), (92, 1, None)]
    d = spark.createDataFrame(rows, "id long, y int, s string")
    got = fits.quota_batches(d, "id", "y", "s", {"a": 0.25, "b": 0.75}, 200, 10).collect()
    assert len(got) == 2000 and {r["source"] for r in got} == {"a", "b"}
    assert all(r["label"] == (r["place"] >= 5) == r["key"] % 2 for r in got)
    assert np.mean([r["source"] == "b" for r in got]) == pytest.approx(0.75, abs=0.04)
    assert len({r["key"] for r in got}) == 90
    other = fits.quota_batches(d, "id", "y", "s", {"none": 1.0}, 100, 10).collect()
    assert len(other) == 1000 and np.mean([r["source"] == "c" for r in other if r["label"] == 1]) == pytest.approx(1 / 3, abs=0.08)


def test_attribution_adds_up(spark):
    d = spark.createDataFrame([(1, 0.2, -1.0, None), (2, 0.9, 0.0, -2.0), (3, float("nan"), 1.0, 0.0)], "id long, s1 double, s2 double, s3 double")
    raw = {r["id"]: r["raw"] for r in folds.tree_scores(d, ["s1", "s2", "s3"], plans.TREES, "id").collect()}
    for r in folds.tree_attribution(d, ["s1", "s2", "s3"], plans.TREES, "id").collect():
        assert r["bias"] + sum(r["parts"].values()) == pytest.approx(raw[r["id"]])


def test_drift_of_one_and_two_windows(spark):
    d = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("b", 0, [1.0, 0.0]), ("c", 0, None)], "clip string, k int, e array<double>")
    got = {r["clip"]: tuple(r)[1:] for r in fits.drift(d, "clip", "k", "e").collect()}
    assert got == {"a": (1, 1.0, 1.0, 0.0, 1.0, 0.0), "b": (2, 0.0, 0.0, 0.0, 0.0, 1.0)}


def test_lag_and_noise_level():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.1, 9000)
    for late in (0, 1, 77, -300):
        assert dsp.lag_of(x, np.roll(x, late)) == late
    assert dsp.lag_of(np.zeros(50), np.zeros(50)) == dsp.lag_of(np.zeros(0), x) == 0
    assert dsp.snr_db(x, x) == 120 and dsp.snr_db(x, x + 0.01 * rng.normal(0, 1, 9000)) == pytest.approx(20, abs=0.5)


GOOD = {"weights": {"s1": 0.6, "s2": 0.4}, "references": {"s1": [0, 1.5], "s2": [-1, 2]}, "platt": {"a": 1.0, "b": 0.5, "prior_shift": 0}, "suppression": {"applied": False}}
#: Documents of constants by what is wrong with them.
CASES = [
    ("", GOOD),
    ("", {**GOOD, "weights": None, "alpha": 0.25}),
    ("", {k: v for k, v in GOOD.items() if k != "suppression"}),
    ("alpha or weights", {**GOOD, "alpha": 0.25}),
    ("alpha or weights", {**GOOD, "weights": None}),
    ("alpha", {**GOOD, "weights": None, "alpha": True}),
    ("alpha", {**GOOD, "weights": None, "alpha": 1.5}),
    ("alpha", {**GOOD, "weights": None, "alpha": "0.5"}),
    ("weights", {**GOOD, "weights": {"s1": 0.6, "s2": 0.5}}),
    ("weights", {**GOOD, "weights": {"s1": 1.4, "s2": -0.4}}),
    ("weights", {**GOOD, "weights": {"s1": 0.6, "s2": "0.4"}}),
    ("weights", {**GOOD, "weights": {}}),
    ("weights", {**GOOD, "weights": [0.6, 0.4]}),
    ("unknown name", {**GOOD, "weights": {"s1": 0.6, "other": 0.4}}),
    ("reference", {**GOOD, "references": {"s1": [0, 1.5], "s2": [2, -1]}}),
    ("reference", {**GOOD, "references": {"s1": [0, 1.5]}}),
    ("reference", {**GOOD, "references": {"s1": [], "s2": [1]}}),
    ("reference", {**GOOD, "references": {"s1": [0, True], "s2": [1]}}),
    ("reference", {**GOOD, "references": 3}),
    ("platt", {**GOOD, "platt": {"a": "1", "b": 0.5, "prior_shift": 0}}),
    ("platt", {**GOOD, "platt": {"a": 1, "b": 0.5}}),
    ("suppression", {**GOOD, "suppression": {"applied": True, "logit_below": -3}}),
    ("", {**GOOD, "suppression": {"applied": True, "logit_below": -3, "rank_above": 0.5, "multiply_by": 1e-3}}),
]


def test_constants_and_what_is_wrong_with_them(spark):
    rows = [(json.dumps(d), want) for want, d in CASES] + [(None, "not json"), ("{", "not json"), ("[1]", "not an object"), ("3", "not an object")]
    d = spark.createDataFrame(rows, "t string, want string")
    got = d.select("t", "want", expect.constants_problem(F.col("t"), ("s1", "s2", "s3")).alias("problem")).collect()
    assert [(r["t"], r["problem"]) for r in got] == [(r["t"], r["want"]) for r in got]


def test_constants_and_manifests(spark, tmp_path):
    names = ("s1", "s2", "s3")
    good = spark.createDataFrame([(json.dumps(GOOD),)], "text string")
    sinks.constants(good, str(tmp_path / "c"), "text", names)
    assert readers.constants(spark, str(tmp_path / "c"), names) == GOOD
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.constants(good, str(tmp_path / "c"), "text", names)
    for bad in (good.union(good), good.limit(0), spark.createDataFrame([("{}",)], "text string")):
        with pytest.raises(sinks.Refused):
            sinks.constants(bad, str(tmp_path / "d"), "text", names)
    assert not (tmp_path / "d").exists() and expect.document_problem(spark, None, names) == "not json"
    (tmp_path / "m.csv").write_text("path,label\nz,1\na,0\nm,1\n")
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.csv")).collect()] == [(0, "z"), (1, "a"), (2, "m")]
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "m.csv"), "id")


def test_refused_submission_leaves_nothing(spark, tmp_path):
    d = spark.createDataFrame([(0, "a\tb", 0.1), (1, "", 0.2)], "ord long, filename string, `cm-score` double")  # an empty name reads back as null
    with pytest.raises(sinks.Refused):
        sinks.submission(d, str(tmp_path / "s"))
    assert not list(tmp_path.glob("s*"))
