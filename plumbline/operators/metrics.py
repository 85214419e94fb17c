"""Decision metrics over a long score table: keys, score, y in {0, 1} (null: left out).

Everything is built on `roc`: counts of each distinct score and running counts from the highest score down, so no
score meets every threshold. A file is called positive when its score is at least the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.functions.prefix import following, running
from plumbline.functions.scalars import BRIEF, bayes_threshold, finite


def counted(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, pos, neg): rows of each label at each distinct finite score."""
    ok = scores.filter(F.col("y").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return ok.groupBy(*keys, "score").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))


def roc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, pos, neg, tp, fp, n_pos, n_neg): tp and fp count rows at or above the score."""
    at = settled(counted(scores, keys).withColumn("down", -F.col("score")))  # read four times below
    run = running(at, keys, "down", ["pos", "neg"]).withColumnsRenamed({"run_pos": "tp", "run_neg": "fp"}).drop("down")
    totals = at.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    return run.alias("r").join(F.broadcast(totals.alias("t")) if not keys else totals.alias("t"), on).select("r.*", "n_pos", "n_neg")


def cost(p_fa: Column, p_miss: Column, c: tuple[float, float, float]) -> Column:
    """Expected cost over that of the better constant decision."""
    c_fa, c_miss, prior = c
    return (c_fa * (1 - prior) * p_fa + c_miss * prior * p_miss) / min(c_fa * (1 - prior), c_miss * prior)


def rates() -> tuple[Column, Column]:
    return F.col("fp") / F.expr("nullif(n_neg, 0)"), 1 - F.col("tp") / F.expr("nullif(n_pos, 0)")


def min_dcf(scores: DataFrame, keys: list[str], c: tuple[float, float, float] = BRIEF) -> DataFrame:
    """(keys, min_dcf): least cost over the curve's vertices and the constant decisions; null with one class."""
    p_fa, p_miss = rates()
    return roc(scores, keys).groupBy(*keys).agg(F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), F.least(F.lit(1.0), F.min(cost(p_fa, p_miss, c)))).alias("min_dcf"))


def eer(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eer): mean of both error rates where they are closest, the highest such threshold; corners only.

    Vertices on a straight line between their neighbours are no corners and are left out.
    """
    r = following(settled(roc(scores, keys).withColumn("down", -F.col("score"))), keys, "down", ["pos", "neg"])
    dp, dn = F.col("next_pos"), F.col("next_neg")
    corner = dp.isNull() | (F.col("pos") * dn != F.col("neg") * dp)
    p_fa, p_miss = rates()
    start = r.groupBy(*keys).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")).select(*keys, F.lit(float("inf")).alias("score"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "n_pos", "n_neg")
    at = r.withColumn("corner", corner).filter("corner").select(*keys, "score", "tp", "fp", "n_pos", "n_neg").unionByName(start)
    at = at.withColumns({"fnr": p_miss, "fpr": p_fa}).filter("fnr is not null and fpr is not null")
    gap = F.round(F.abs(F.col("fnr") - F.col("fpr")), 12)
    best = F.min_by(F.struct("fnr", "fpr"), F.struct(gap, -F.col("score")))
    return at.groupBy(*keys).agg(best.alias("b")).select(*keys, ((F.col("b.fnr") + F.col("b.fpr")) / 2).alias("eer"))


def auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc): share of (positive, negative) pairs in order, ties a half; null with one class."""
    r = roc(scores, keys)
    won = F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2.0)
    return r.groupBy(*keys).agg((F.sum(won) / F.expr("nullif(max(n_pos) * max(n_neg), 0)")).alias("auc"))


def error_counts(scores: DataFrame, keys: list[str], threshold: Column | float) -> DataFrame:
    """(keys, n_pos, n_neg, fa, miss) at a threshold, a number or a column of `scores`."""
    called = F.col("score") >= threshold
    one = lambda c: F.sum(c.cast("long"))
    ok = scores.filter("y is not null and score is not null and not isnan(score)")
    return ok.groupBy(*keys).agg(one(F.col("y") == 1).alias("n_pos"), one(F.col("y") == 0).alias("n_neg"), one((F.col("y") == 0) & called).alias("fa"), one((F.col("y") == 1) & ~called).alias("miss"))


def cost_at(scores: DataFrame, keys: list[str], threshold: Column | float, c: tuple[float, float, float] = BRIEF) -> DataFrame:
    """(keys, p_fa, p_miss, cost) at a threshold."""
    n = error_counts(scores, keys, threshold)
    p_fa, p_miss = F.expr("fa / nullif(n_neg, 0)"), F.expr("miss / nullif(n_pos, 0)")
    return n.select(*keys, p_fa.alias("p_fa"), p_miss.alias("p_miss"), cost(p_fa, p_miss, c).alias("cost"))


def act_dcf(scores: DataFrame, keys: list[str], c: tuple[float, float, float] = BRIEF) -> DataFrame:
    return cost_at(scores, keys, bayes_threshold(*c), c).select(*keys, F.col("cost").alias("act_dcf"))


#: How a threshold is picked among those of least cost. Fixed values.
PICKS = ("lowest", "lowest_or_refuse", "highest", "highest_or_refuse")


def pick_threshold(scores: DataFrame, keys: list[str], how: str = "lowest", c: tuple[float, float, float] = BRIEF) -> DataFrame:
    """(keys, threshold, cost): observed score of least cost; lowest or highest among ties.

    *_or_refuse also offers infinity, that is calling nothing positive.
    """
    p_fa, p_miss = rates()
    at = roc(scores, keys).select(*keys, "score", F.round(cost(p_fa, p_miss, c), 12).alias("cost")).filter("cost is not null")
    if how.endswith("refuse"):
        refuse = cost(F.lit(0.0), F.lit(1.0), c)
        at = at.unionByName(at.select(*keys).distinct().select(*keys, F.lit(float("inf")).alias("score"), F.round(refuse, 12).alias("cost")))
    tie = F.col("score") if how.startswith("lowest") else -F.col("score")
    best = F.min_by(F.struct("score", "cost"), F.struct("cost", tie))
    return at.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.score").alias("threshold"), F.col("b.cost").alias("cost"))


def sponsor_min_dcf(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sponsor_min_dcf): higher means negative class; rows are swept one by one, positives last in ties.

    Costs: a miss of a positive 1, a false alarm 10, prior 0.05 of the rare class are replaced by equal priors:
    cost 0.5 * p_miss + 0.5 * p_fa over 0.5, the start counted. A tie's rows step through negatives first.
    """
    at = counted(scores, keys)
    run = running(at, keys, "score", ["pos", "neg"])
    totals = at.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    both = run.alias("r").join(totals.alias("t"), on).select("r.*", "n_pos", "n_neg")
    miss = lambda neg: neg / F.expr("nullif(n_neg, 0)")
    fa = lambda pos: 1 - pos / F.expr("nullif(n_pos, 0)")
    after = miss(F.col("run_neg")) + fa(F.col("run_pos"))
    inside = miss(F.col("run_neg")) + fa(F.col("run_pos") - F.col("pos"))
    return both.groupBy(*keys).agg(F.least(F.lit(1.0), F.min(F.least(after, inside))).alias("sponsor_min_dcf"))


def average_ranks(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """`df` plus the average rank of `col` inside the keys, ties sharing the mean."""
    counts = df.groupBy(*keys, col).agg(F.count("*").alias("_n"))
    run = running(counts, keys, col, ["_n"]).select(*keys, col, (F.col("run__n") - (F.col("_n") - 1) / 2.0).alias(name))
    on = F.col(f"d.{col}").eqNullSafe(F.col(f"c.{col}"))
    for k in keys:
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}"))
    return df.alias("d").join(run.alias("c"), on).select("d.*", f"c.{name}")


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, spearman) over rows finite in both; null under three rows or for a constant."""
    ok = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    ranked = average_ranks(average_ranks(ok, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("_ra", "_rb")).alias("spearman"))


def against_all(scores: DataFrame, group: str, label: int, twice: bool = True) -> tuple[DataFrame, DataFrame]:
    """Each group's rows of `label` against all rows of the other label, whichever group these are in.

    Two tables. At most one row for each score that a group has: (group, score, n, above, at, n_own, n_rest), where n
    are the group's rows there, above and at count the other label's rows with a higher and with the same score. And
    the points of each group's curve: (group, place, tp, fp, n_pos, n_neg), place counting the rows called positive.

    Between two scores of its own a group's curve is a straight line, so only its ends are made: the other label's
    rows are counted once, not once for each group. Null groups are a group; null and NaN scores are left out.
    `twice`: both tables will be read.
    """
    ok = scores.filter(F.col("y").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    counts = ok.groupBy(F.when(F.col("y") == label, F.col(group)).alias("group"), "y", "score").agg(F.count("*").alias("n"))
    counts = settled(counts)
    own, rest = counts.filter(F.col("y") == label).drop("y"), counts.filter(F.col("y") == 1 - label)
    every = own.select("score", F.lit(0).cast("long").alias("n")).unionByName(rest.select("score", "n")).groupBy("score").agg(F.sum("n").alias("at"))
    every = running(settled(every.withColumn("down", -F.col("score"))), [], "down", ["at"])
    n_rest = rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mine = running(own.withColumn("down", -F.col("score")), ["group"], "down", ["n"]).drop("down")
    totals = own.groupBy("group").agg(F.sum("n").alias("n_own"))
    placed = mine.join(every.select("score", "at", (F.col("run_at") - F.col("at")).alias("above")), "score").alias("m")
    placed = placed.join(totals.alias("t"), F.col("m.group").eqNullSafe(F.col("t.group"))).select("m.*", "t.n_own", F.lit(n_rest).alias("n_rest"))
    placed = settled(placed) if twice else placed
    ends = [(F.col("run_n") - F.col("n"), F.col("above")), (F.col("run_n"), F.col("above") + F.col("at")), (F.lit(0), F.lit(0)), (F.col("n_own"), F.col("n_rest"))]
    point = lambda o, r: F.struct(o.cast("long").alias("own"), r.cast("long").alias("rest"))
    points = placed.select("group", "n_own", "n_rest", F.explode(F.array(*[point(*e) for e in ends])).alias("p")).distinct()
    pos, neg = ("own", "rest") if label else ("rest", "own")
    points = points.select("group", (F.col("p.own") + F.col("p.rest")).cast("double").alias("place"), F.col(f"p.{pos}").alias("tp"), F.col(f"p.{neg}").alias("fp"), F.col(f"n_{pos}").alias("n_pos"), F.col(f"n_{neg}").alias("n_neg"))
    return placed.drop("run_n"), points


def _least(points: DataFrame, c: tuple[float, float, float]) -> DataFrame:
    p_fa, p_miss = rates()
    least = F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), F.least(F.lit(1.0), F.min(cost(p_fa, p_miss, c))))
    return points.groupBy("group").agg(least.alias("min_dcf"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))


def group_least(scores: DataFrame, group: str, label: int, c: tuple[float, float, float] = BRIEF) -> DataFrame:
    """(group, n, n_rest, min_dcf): group_report() without the figures that need more than the least cost."""
    d = _least(against_all(scores, group, label, twice=False)[1], c)
    own, rest = ("n_pos", "n_neg") if label else ("n_neg", "n_pos")
    return d.select("group", F.col(own).alias("n"), F.col(rest).alias("n_rest"), "min_dcf")


def group_report(scores: DataFrame, group: str, label: int, c: tuple[float, float, float] = BRIEF) -> DataFrame:
    """(group, n, n_rest, auc, min_dcf, eer) of each group's rows of `label` against all rows of the other one.

    auc, min_dcf and eer are those that auc(), min_dcf() and eer() give of the group's rows with the others beside
    them; null if there are no others.
    """
    placed, points = against_all(scores, group, label)
    points = settled(points)
    below = F.col("n_rest") - F.col("above") - F.col("at") if label else F.col("above")
    won = F.sum(F.col("n") * (below + F.col("at") / 2.0)) / F.expr("nullif(max(n_own) * max(n_rest), 0)")
    n = placed.groupBy("group").agg(F.max("n_own").alias("n"), F.max("n_rest").alias("n_rest"), won.alias("auc"))

    p_fa, p_miss = rates()
    then = following(points, ["group"], "place", ["tp", "fp"]).withColumn("back", -F.col("place"))
    both = following(settled(then.withColumnsRenamed({"next_tp": "then_tp", "next_fp": "then_fp"})), ["group"], "back", ["tp", "fp"])
    into = (F.col("tp") - F.col("next_tp"), F.col("fp") - F.col("next_fp"))
    out = (F.col("then_tp") - F.col("tp"), F.col("then_fp") - F.col("fp"))
    corner = F.coalesce(into[0] * out[1] != into[1] * out[0], F.lit(True))
    at = both.filter(corner).select("group", "place", p_miss.alias("fnr"), p_fa.alias("fpr")).filter("fnr is not null and fpr is not null")
    best = F.min_by(F.struct("fnr", "fpr"), F.struct(F.round(F.abs(F.col("fnr") - F.col("fpr")), 12), "place"))
    equal = at.groupBy("group").agg(best.alias("b")).select("group", ((F.col("b.fnr") + F.col("b.fpr")) / 2).alias("eer"))
    for part in (_least(points, c).select("group", "min_dcf"), equal):
        d, e = n.alias("d"), part.alias("e")
        n = d.join(e, F.col("d.group").eqNullSafe(F.col("e.group")), "left").select("d.*", f"e.{part.columns[1]}")
    return n


def masked_report(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_masked, status, auc, min_dcf) of labelled rows: those without a finite score are counted and left out.

    status: ok, one class, or empty if no score is finite.
    """
    use = finite(F.col("score"))
    rows = settled(scores.filter("y is not null").select(*keys, "y", F.when(use, F.col("score")).alias("score")))
    seen = F.when(F.col("score").isNotNull(), F.col("y"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("n_masked"), F.min(seen).alias("least"), F.max(seen).alias("most"))
    status = F.when(F.col("least").isNull(), "empty").when(F.col("least") == F.col("most"), "one class").otherwise("ok")
    n = n.select(*keys, "n", "n_masked", status.alias("status"))
    for part in (auc(rows, keys), min_dcf(rows, keys)):
        n = n.join(part, keys, "left")
    return n
