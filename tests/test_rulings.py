"""Group reports, plans of changes, rules on gains and probes against plain versions."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import augment, metrics, rulings


def hashed(text):
    return int(hashlib.sha1(text.encode()).hexdigest()[:16], 16) / 18446744073709551616


def near(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9)


# group reports


@pytest.mark.parametrize("label", [0, 1])
def test_group_report_equals_each_group_by_itself(spark, label):
    rng = random.Random(label)
    rows = [(rng.choice("abc") if rng.random() < 0.9 else None, rng.choice([0, 1, 1, None]), rng.choice([float(rng.randrange(6)), rng.gauss(0, 1), float("nan"), None])) for _ in range(400)]
    rows += [("only", label, 2.0), ("tied", label, 3.0), ("tied", label, 3.0), ("low", label, -9.0), ("other", 1 - label, 1.0)]
    scores = spark.createDataFrame(rows, "g string, y int, score double")
    got = {r["group"]: r for r in metrics.group_report(scores, "g", label).collect()}
    fine = [r for r in rows if r[1] is not None and r[2] is not None and r[2] == r[2]]
    groups = {g for g, y, _ in fine if y == label}
    assert set(got) == groups and "other" not in got
    beside = [(str(g), y, s) for g in groups for k, y, s in fine if y == 1 - label or k == g]
    each = spark.createDataFrame(beside, "g string, y int, score double")
    want = {r["g"]: r for r in metrics.auc(each, ["g"]).join(metrics.min_dcf(each, ["g"]), "g").join(metrics.eer(each, ["g"]), "g").collect()}
    for g, r in got.items():
        w = want[str(g)]
        assert near(r["auc"], w["auc"]) and near(r["min_dcf"], w["min_dcf"]) and near(r["eer"], w["eer"]), (g, r, w)
        assert r["n"] == sum(k == g and y == label for k, y, _ in fine) and r["n_rest"] == sum(y == 1 - label for _, y, _ in fine)
    least = {r["group"]: r for r in metrics.group_least(scores, "g", label).collect()}
    assert {g: (r["n"], r["n_rest"], r["min_dcf"]) for g, r in least.items()} == {g: (r["n"], r["n_rest"], r["min_dcf"]) for g, r in got.items()}


def test_group_report_without_the_other_label_or_rows(spark):
    one = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7)], "g string, y int, score double")
    (row,) = metrics.group_report(one, "g", 1).collect()
    assert (row["n"], row["n_rest"], row["auc"], row["min_dcf"], row["eer"]) == (2, 0, None, None, None)
    assert metrics.group_report(one.limit(0), "g", 1).count() == 0


# plans of changes


def plain_plan(row, seed, epoch, coded):
    u = lambda what: hashed(f"{seed}:{epoch}:{row}:{what}")
    if u("any") >= 0.65:
        return []
    times = sorted((-math.log(1 - u(op)) / w, op) for op, w in {"noise": 1, "band": 2, "reverb": 1, "gain_clip": 1, "codec": 1}.items() if op != "codec" or coded)
    plan = []
    for _, op in times[: 1 if u("many") < 0.6 else 2]:
        v = u(f"{op}:value")
        plan.append((op, {"noise": 5 + 25 * v, "band": (3400.0, 4000.0)[int(2 * v)], "reverb": 0.2 + 0.6 * v, "gain_clip": -12 + 24 * v, "codec": 0.0}[op]))
    return plan + ([("rawboost_conv", 0.0)] if u("filter") < 0.25 else [])


def test_plans(spark):
    rows = spark.range(600).withColumn("plan_", F.lit("kept"))
    made = augment.planned(rows, "id", 5, 2, F.col("id") % 3 != 0)
    again = augment.planned(rows.repartition(7), "id", 5, 2, F.col("id") % 3 != 0)
    got = {r["id"]: [(c["op"], c["value"]) for c in r["plan"]] for r in made.collect()}
    assert got == {r["id"]: [(c["op"], c["value"]) for c in r["plan"]] for r in again.collect()}
    for i, plan in got.items():
        want = plain_plan(i, 5, 2, i % 3 != 0)
        assert [op for op, _ in plan] == [op for op, _ in want]
        assert all(math.isclose(a, b) for (_, a), (_, b) in zip(plan, want))
        assert len({op for op, _ in plan}) == len(plan)
    assert not any(op == "codec" for i, p in got.items() if i % 3 == 0 for op, _ in p)
    assert got != {r["id"]: [(c["op"], c["value"]) for c in r["plan"]] for r in augment.planned(rows, "id", 5, 3, F.col("id") % 3 != 0).collect()}


def test_plans_follow_their_odds(spark):
    rows = augment.planned(spark.range(40_000), "id", 1)
    t = {r["op"]: r["rate"] for r in augment.tally(rows, []).collect()}
    assert abs(t["clean"] - 0.35) < 0.01 and abs(t["rawboost_conv"] - 0.65 * 0.25) < 0.01
    drawn = {op: t[op] for op in augment.WEIGHTS}
    assert abs(sum(drawn.values()) - 0.65 * 1.4) < 0.015
    first = 0.65 * 2 / 6  # the odds of the heavier change to come first, and to come second after a lighter one
    second = 0.65 * 0.4 * 4 * (1 / 6) * (2 / 5)
    assert abs(drawn["band"] - first - second) < 0.012


def test_plans_of_nothing_and_tallies_of_null_keys(spark):
    none = spark.createDataFrame([(None, None, 0), (None, "a", 1), (1, None, 1)], "id long, k string, y int")
    made = augment.planned(none, "id")
    assert [r["plan"] for r in made.filter("id is null").collect()] == [[], []]
    t = Counter()
    for r in augment.tally(made, ["k"]).collect():
        t[r["k"]] += r["n"] if r["op"] == "clean" else 0
        assert 0 < r["rate"] <= 1
    assert t["a"] == 1 and t[None] >= 1
    assert augment.tally(made.limit(0), ["k"]).count() == 0 and augment.planned(none.limit(0), "id").count() == 0


def test_changes_that_fall_on_one_label_are_seen(spark):
    rows = augment.planned(spark.range(8000).withColumn("y", (F.col("id") % 2).cast("int")), "id", 4)
    assert not any(r["skewed"] for r in augment.independence(rows, "y").collect())
    leaning = rows.withColumn("plan", F.when((F.col("y") == 1) & (F.col("id") % 5 == 0), F.array().cast(augment.PLAN)).otherwise(F.col("plan")))
    assert {r["op"]: r["skewed"] for r in augment.independence(leaning, "y").collect()}["clean"]
    alone = augment.independence(rows.filter("y = 0"), "y").collect()
    assert alone and not any(r["skewed"] or r["gap"] is not None for r in alone)


def test_changes_in_turn(spark):
    got = augment.cycled(spark.createDataFrame([(float(x), "kept") for x in (9, 3, 7, 1, 5, 11, 2)], "at double, extra string"), "at", 6).collect()
    order = sorted(got, key=lambda r: r["at"])
    assert [r["row"] for r in order] == list(range(7)) and [r["op"] for r in order] == [augment.CYCLE[i % 5] for i in range(7)]
    for r in order:
        u = hashed(f"6:{r['row']}")
        want = {"noise": 5 + 25 * u, "band": (3400.0, 4000.0)[int(2 * u)], "reverb": 0.2 + 0.6 * u, "gain_clip": -12 + 24 * u, "rawboost_conv": 0.0}[r["op"]]
        assert math.isclose(r["value"], want) and r["extra"] == "kept"


# rules and probes


def test_rules_at_their_bounds(spark):
    rows = [
        ("all", 0.03, 0.03, -0.05, -0.03, 19),
        ("few", 0.03, 0.03, 0.0, 0.0, 18),
        ("just", 0.0999 - 0.0699, 0.03, 0.0, 0.0, 40),
        ("worse", 0.01, -0.0101, -0.0501, -0.0301, 0),
        ("unknown", None, 0.5, 0.5, None, None),
    ]
    d = spark.createDataFrame(rows, "candidate string, itw_brief double, itw_averse double, holdout_brief double, inner_brief double, catches long")
    got = {r["candidate"]: (r["room"], r["room_failed"], r["standing"], r["standing_failed"]) for r in rulings.ruled(d).collect()}
    assert got["all"] == ("PASS", "", "PASS", "")
    assert got["few"] == ("FAIL", "catches", "PASS", "")
    assert got["just"] == ("PASS", "", "PASS", "")
    assert got["worse"] == ("FAIL", "itw_brief_gain,itw_averse_gain,catches", "FAIL", "itw_averse_reg,holdout_brief_reg,inner_brief_reg")
    assert got["unknown"] == ("FAIL", "itw_brief_gain,catches", "FAIL", "itw_brief_gain,inner_brief_reg")


def test_a_cache_of_errors_is_inconclusive(spark):
    errors = rulings.with_columns_of(spark.createDataFrame([("a", 0), ("b", 1)], "path string, Y int"), {"y": "int", "score": "double", "kind": "string"})
    assert errors.columns == ["path", "Y", "score", "kind"]
    rows = spark.createDataFrame([(c, k, y, s) for c, k, y, s in [("old", "none", 1, 2.0), ("old", "none", 0, 1.0), ("old", "noisy", 1, 2.0), ("old", "noisy", 0, 3.0), ("new", "none", 1, 2.0), ("new", "none", 0, 0.0), ("new", "noisy", 1, float("inf")), ("new", "noisy", 0, None)]], "candidate string, kind string, y int, score double")
    cells = rulings.probe_cells(rows)
    by = {(r["candidate"], r["kind"]): (r["n"], r["n_errors"], r["auc"]) for r in cells.collect()}
    assert by == {("old", "none"): (2, 0, 1.0), ("old", "noisy"): (2, 0, 0.0), ("new", "none"): (2, 0, 1.0), ("new", "noisy"): (0, 2, None)}
    read = lambda ref: {r["candidate"]: r["reading"] for r in rulings.probe_reading(cells, "none", "noisy", ref, 0.5, 0.005).collect()}
    assert read("old") == {"old": "FAIL", "new": "inconclusive"}
    assert read("absent") == {"old": "inconclusive", "new": "inconclusive"}
    stored = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", None)], "path string, score double").withColumn("who", F.lit("x"))
    again = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)], "path string, score double").withColumn("who", F.lit("x"))
    assert [tuple(r) for r in rulings.self_check(again, stored, ["path", "who"], "who").collect()] == [("x", 2, 0.5)]
