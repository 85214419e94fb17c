"""Queries of the decision-metric family."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.functions.prefix import quantiles
from plumbline.functions.scalars import AVERSE, BRIEF
from plumbline.operators import metrics as me
from plumbline.plans.fusion import AVERSE_SQL, BRIEF_SQL, DCF_SQL
from plumbline.sources.tables import EV, evaluation, long_scores, table

QUERIES, ORACLES = {}, {}
KEYS = ["candidate", "split"]
R6 = lambda c: F.round(c, 6).alias(c)
SC = f"WITH {EV}, sc AS (SELECT candidate, split, source, generator, y, round(score, 9) AS score, path FROM scores WHERE y IS NOT NULL)"
K = "candidate, split"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def scores(spark, sf_dir):
    return long_scores(evaluation(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("roc_curve", SC + DCF_SQL.format(k=K, **BRIEF_SQL) + " SELECT candidate, split, score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM rocs")
def roc_curve(spark, sf_dir):
    return me.roc(scores(spark, sf_dir), KEYS).select(*KEYS, "score", "tp", "fp")


@query("min_dcf", SC + DCF_SQL.format(k=K, **BRIEF_SQL) + " SELECT candidate, split, round(min_dcf,6) AS min_dcf FROM dcf")
def min_dcf(spark, sf_dir):
    return me.min_dcf(scores(spark, sf_dir), KEYS).select(*KEYS, R6("min_dcf"))


@query("min_dcf_averse", SC + DCF_SQL.format(k=K, **AVERSE_SQL) + " SELECT candidate, split, round(min_dcf,6) AS min_dcf FROM dcf")
def min_dcf_averse(spark, sf_dir):
    return me.min_dcf(scores(spark, sf_dir), KEYS, AVERSE).select(*KEYS, R6("min_dcf"))


EER_SQL = """, e0 AS (SELECT *, lead(pos) OVER w AS dp, lead(neg) OVER w AS dn FROM rocs WINDOW w AS (PARTITION BY candidate, split ORDER BY score DESC)),
e1 AS (SELECT candidate, split, score, 1e0-tp/np::DOUBLE AS fnr, fp/nn::DOUBLE AS fpr FROM e0 WHERE dp IS NULL OR pos*dn <> neg*dp
 UNION ALL SELECT DISTINCT candidate, split, 'infinity'::DOUBLE, 1e0, 0e0 FROM e0),
e2 AS (SELECT *, row_number() OVER (PARTITION BY candidate, split ORDER BY round(abs(fnr-fpr),12), score DESC) AS rn FROM e1)"""


@query("eer", SC + DCF_SQL.format(k=K, **BRIEF_SQL) + EER_SQL + " SELECT candidate, split, round((fnr+fpr)/2e0,6) AS eer FROM e2 WHERE rn=1")
def eer(spark, sf_dir):
    return me.eer(scores(spark, sf_dir), KEYS).select(*KEYS, R6("eer"))


@query("auc", SC + DCF_SQL.format(k=K, **BRIEF_SQL) + " SELECT candidate, split, round(sum(pos*(nn-fp+neg/2e0))/(max(np)*max(nn)),6) AS auc FROM rocs GROUP BY ALL")
def auc(spark, sf_dir):
    return me.auc(scores(spark, sf_dir), KEYS).select(*KEYS, R6("auc"))


RATES_SQL = ", rate AS (SELECT {k}, avg((score>={t})::INT) FILTER (y=0) AS p_fa, avg((score<{t})::INT) FILTER (y=1) AS p_miss FROM {f} GROUP BY {k})"


@query("cost_at", SC + RATES_SQL.format(k=K, t="0.5e0", f="sc") + " SELECT candidate, split, round(p_fa,6) AS p_fa, round(p_miss,6) AS p_miss, round((2.8e0*p_fa+0.3e0*p_miss)/0.3e0,6) AS cost FROM rate")
def cost_at(spark, sf_dir):
    return me.cost_at(scores(spark, sf_dir), KEYS, 0.5).select(*KEYS, R6("p_fa"), R6("p_miss"), R6("cost"))


@query("act_dcf", SC + RATES_SQL.format(k=K, t="(ln(4e0)-ln(0.3e0/0.7e0))", f="sc") + " SELECT candidate, split, round((2.8e0*p_fa+0.3e0*p_miss)/0.3e0,6) AS act_dcf FROM rate")
def act_dcf(spark, sf_dir):
    return me.act_dcf(scores(spark, sf_dir), KEYS).select(*KEYS, R6("act_dcf"))


SPONSOR_SQL = """, sp AS (SELECT candidate, split, score, y, row_number() OVER w AS rn, sum(y) OVER w AS cp, sum(1-y) OVER w AS cn, sum(y) OVER a AS np, sum(1-y) OVER a AS nn FROM sc WINDOW w AS (PARTITION BY candidate, split ORDER BY score, y, path), a AS (PARTITION BY candidate, split))
SELECT candidate, split, round(least(1e0, min(cn/nullif(nn,0)::DOUBLE + 1e0 - cp/nullif(np,0)::DOUBLE)),6) AS sponsor_min_dcf FROM sp GROUP BY ALL"""


@query("sponsor_min_dcf", SC + SPONSOR_SQL)
def sponsor_min_dcf(spark, sf_dir):
    return me.sponsor_min_dcf(scores(spark, sf_dir), KEYS).select(*KEYS, R6("sponsor_min_dcf"))


@query(
    "metric_report",
    SC + DCF_SQL.format(k=K, **BRIEF_SQL) + EER_SQL + RATES_SQL.format(k=K, t="(ln(4e0)-ln(0.3e0/0.7e0))", f="sc")
    + ", au AS (SELECT candidate, split, sum(pos*(nn-fp+neg/2e0))/(max(np)*max(nn)) AS auc, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg FROM rocs GROUP BY ALL) SELECT candidate, split, n_pos, n_neg, round(auc,6) AS auc, round(min_dcf,6) AS min_dcf, round((fnr+fpr)/2e0,6) AS eer, round((2.8e0*p_fa+0.3e0*p_miss)/0.3e0,6) AS act_dcf FROM au JOIN dcf USING (candidate, split) JOIN rate USING (candidate, split) JOIN e2 USING (candidate, split) WHERE rn=1",
)
def metric_report(spark, sf_dir):
    s = scores(spark, sf_dir)
    n = me.counted(s, KEYS).groupBy(*KEYS).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    for part in (me.auc(s, KEYS), me.min_dcf(s, KEYS), me.eer(s, KEYS), me.act_dcf(s, KEYS)):
        n = n.join(part, KEYS)
    return n.select(*KEYS, "n_pos", "n_neg", R6("auc"), R6("min_dcf"), R6("eer"), R6("act_dcf"))


GROUP_SQL = """WITH {ev}, base AS (SELECT y, round(s1,9) AS score, {g} AS grp FROM ev WHERE split='inner_oof' AND y IS NOT NULL),
sc AS (SELECT grp, y, score FROM base WHERE y={own} UNION ALL SELECT g.grp, b.y, b.score FROM base b, (SELECT DISTINCT grp FROM base WHERE y={own}) g WHERE b.y=1-{own})"""


def by_group(spark, sf_dir, group: str, own: int):
    s = evaluation(spark, sf_dir).filter("split = 'inner_oof' and y is not null").select("y", F.round("s1", 9).alias("score"), group)
    d = me.group_least(s, group, own)
    return d.select(F.col("group").alias("grp"), R6("min_dcf"), F.col("n" if own else "n_rest").alias("n_pos"))


for name, column, own in (("by_generator", "generator", 1), ("by_source", "source", 0)):
    query(name, GROUP_SQL.format(ev=EV, g=column, own=own) + DCF_SQL.format(k="grp", **BRIEF_SQL) + " SELECT grp, round(min_dcf,6) AS min_dcf, max(np)::BIGINT AS n_pos FROM dcf JOIN rocs USING (grp) GROUP BY grp, min_dcf")(lambda spark, sf_dir, c=column, o=own: by_group(spark, sf_dir, c, o))


REPORT_SQL = GROUP_SQL + DCF_SQL.format(k="grp", **BRIEF_SQL) + EER_SQL.replace("candidate, split", "grp") + ", au AS (SELECT grp, sum(pos*(nn-fp+neg/2e0))/nullif(max(np)*max(nn),0) AS auc, max(np)::BIGINT AS np, max(nn)::BIGINT AS nn FROM rocs GROUP BY grp) SELECT '{g}' AS part, grp, CASE {own} WHEN 1 THEN np ELSE nn END AS n, CASE {own} WHEN 1 THEN nn ELSE np END AS n_rest, round(auc,6) AS auc, round(min_dcf,6) AS min_dcf, round((fnr+fpr)/2e0,6) AS eer FROM au JOIN dcf USING (grp) JOIN e2 USING (grp) WHERE rn=1"


@query("group_report", " UNION ALL ".join(f"SELECT * FROM ({REPORT_SQL.format(ev=EV, g=g, own=own)})" for g, own in (("generator", 1), ("source", 0))))
def group_report(spark, sf_dir):
    """Every generator's positives against all negatives, and every source's negatives against all positives."""
    s = evaluation(spark, sf_dir).filter("split = 'inner_oof' and y is not null").select("y", F.round("s1", 9).alias("score"), "generator", "source")
    parts = [me.group_report(s, g, own).withColumnRenamed("group", "grp").withColumn("part", F.lit(g)) for g, own in (("generator", 1), ("source", 0))]
    return parts[0].unionByName(parts[1]).select("part", "grp", "n", "n_rest", R6("auc"), R6("min_dcf"), R6("eer"))


@query(
    "delta_auc",
    f"WITH {EV}, sc AS (SELECT 's1' AS candidate, split, y, round(s1,9) AS score FROM ev WHERE y IS NOT NULL UNION ALL SELECT 's3', split, y, s3 FROM ev WHERE y IS NOT NULL)" + DCF_SQL.format(k=K, **BRIEF_SQL)
    + ", au AS (SELECT candidate, split, sum(pos*(nn-fp+neg/2e0))/(max(np)*max(nn)) AS auc FROM rocs GROUP BY ALL) SELECT a.split, round(b.auc-a.auc,6) AS delta FROM au a JOIN au b USING (split) WHERE a.candidate='s1' AND b.candidate='s3'",
)
def delta_auc(spark, sf_dir):
    a = me.auc(scores(spark, sf_dir).filter("candidate in ('s1','s3')"), KEYS)
    return a.groupBy("split").pivot("candidate", ["s1", "s3"]).agg(F.max("auc")).select("split", F.round(F.col("s3") - F.col("s1"), 6).alias("delta"))


#: Trivial features whose skill would be a shortcut. Fixed values.
SHORTCUTS = {"n_chars": "n_chars", "fold_digit": "doc_id % 10", "speaker_no": "doc_id % 17"}
SHORT_SQL = f"WITH {EV}, sc AS (SELECT 'n_chars' AS feature, y, n_chars::DOUBLE AS score FROM ev WHERE y IS NOT NULL UNION ALL SELECT 'fold_digit', y, (doc_id%10)::DOUBLE FROM ev WHERE y IS NOT NULL UNION ALL SELECT 'speaker_no', y, (doc_id%17)::DOUBLE FROM ev WHERE y IS NOT NULL)" + DCF_SQL.format(k="feature", **BRIEF_SQL) + ", au AS (SELECT feature, sum(pos*(nn-fp+neg/2e0))/(max(np)*max(nn)) AS auc, count(*) AS n_distinct FROM rocs GROUP BY ALL)"


def shortcut_scores(spark, sf_dir):
    ev = evaluation(spark, sf_dir).filter("y is not null")
    return ev.select("y", *[F.expr(e).cast("double").alias(k) for k, e in SHORTCUTS.items()]).unpivot(["y"], list(SHORTCUTS), "feature", "score")


@query("shortcut_auc", SHORT_SQL + " SELECT feature, round(greatest(auc, 1e0-auc),6) AS skill FROM au")
def shortcut_auc(spark, sf_dir):
    return me.auc(shortcut_scores(spark, sf_dir), ["feature"]).select("feature", F.round(F.greatest("auc", 1 - F.col("auc")), 6).alias("skill"))


@query("shortcut_flag", SHORT_SQL + " SELECT feature, abs(auc-0.5e0) > 0.05e0 AND n_distinct > 1 AS flagged FROM au")
def shortcut_flag(spark, sf_dir):
    s = shortcut_scores(spark, sf_dir)
    n = s.groupBy("feature").agg(F.count_distinct("score").alias("n"))
    return me.auc(s, ["feature"]).join(n, "feature").select("feature", ((F.abs(F.col("auc") - 0.5) > 0.05) & (F.col("n") > 1)).alias("flagged"))


PICK_SQL = """, p AS (SELECT candidate, split, score, round(cost,12) AS cost FROM costs {more}), pr AS (SELECT *, row_number() OVER (PARTITION BY candidate, split ORDER BY cost, score {dir}) AS rn FROM p)
SELECT candidate, split, CASE WHEN isinf(score) THEN 1e9 ELSE score END AS threshold, round(cost,6) AS cost FROM pr WHERE rn=1"""
for how in me.PICKS:
    more = "UNION ALL SELECT DISTINCT candidate, split, 'infinity'::DOUBLE, 1e0 FROM costs" if how.endswith("refuse") else ""

    @query(f"threshold_{how}", SC + DCF_SQL.format(k=K, **BRIEF_SQL) + PICK_SQL.format(more=more, dir="ASC" if how.startswith("lowest") else "DESC"))
    def threshold(spark, sf_dir, how=how):
        p = me.pick_threshold(scores(spark, sf_dir), KEYS, how)
        return p.select(*KEYS, F.when(F.col("threshold") == float("inf"), 1e9).otherwise(F.col("threshold")).alias("threshold"), R6("cost"))


INNER_T = ", p AS (SELECT candidate, split, score, round(cost,12) AS cost FROM costs WHERE split='inner_oof'), t AS (SELECT candidate, score AS thr FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY cost, score) AS rn FROM p) WHERE rn=1)"


@query(
    "rates_at_inner_thr",
    SC + DCF_SQL.format(k=K, **BRIEF_SQL) + INNER_T + ", at_ AS (SELECT s.*, thr FROM sc s JOIN t USING (candidate) WHERE split<>'inner_oof') SELECT candidate, split, round(avg((score>=thr)::INT) FILTER (y=0),6) AS p_fa, round(avg((score<thr)::INT) FILTER (y=1),6) AS p_miss FROM at_ GROUP BY ALL",
)
def rates_at_inner_thr(spark, sf_dir):
    s = scores(spark, sf_dir)
    t = me.pick_threshold(s.filter("split = 'inner_oof'"), ["candidate"]).select("candidate", "threshold")
    at = s.filter("split <> 'inner_oof' and y is not null").join(F.broadcast(t), "candidate")
    return me.cost_at(at, KEYS, F.col("threshold")).select(*KEYS, R6("p_fa"), R6("p_miss"))


@query(
    "argmin_fa_miss",
    SC + DCF_SQL.format(k=K, **BRIEF_SQL) + ", p AS (SELECT *, row_number() OVER (PARTITION BY candidate, split ORDER BY round(cost,12), score) AS rn FROM costs) SELECT candidate, split, fp::BIGINT AS fa, (np-tp)::BIGINT AS miss FROM p WHERE rn=1",
)
def argmin_fa_miss(spark, sf_dir):
    p_fa, p_miss = me.rates()
    r = me.roc(scores(spark, sf_dir), KEYS).withColumn("cost", F.round(me.cost(p_fa, p_miss, BRIEF), 12)).filter("cost is not null")
    return r.groupBy(*KEYS).agg(F.min_by(F.struct("fp", (F.col("n_pos") - F.col("tp")).alias("miss")), F.struct("cost", "score")).alias("b")).select(*KEYS, F.col("b.fp").alias("fa"), "b.miss")


@query(
    "direction_check",
    SC + DCF_SQL.format(k=K, **BRIEF_SQL) + ", au AS (SELECT candidate, split, sum(pos*(nn-fp+neg/2e0))/(max(np)*max(nn)) AS auc FROM rocs GROUP BY ALL), md AS (SELECT candidate, split, quantile_cont(score,0.5) FILTER (y=1) AS mp, quantile_cont(score,0.5) FILTER (y=0) AS mn FROM sc GROUP BY ALL) SELECT candidate, split, auc > 0.5e0 AND mp > mn AS right_way FROM au JOIN md USING (candidate, split)",
)
def direction_check(spark, sf_dir):
    s = scores(spark, sf_dir).filter("y is not null")
    med = s.groupBy(*KEYS).agg(F.percentile(F.when(F.col("y") == 1, F.col("score")), 0.5).alias("mp"), F.percentile(F.when(F.col("y") == 0, F.col("score")), 0.5).alias("mn"))
    return me.auc(s, KEYS).join(med, KEYS).select(*KEYS, ((F.col("auc") > 0.5) & (F.col("mp") > F.col("mn"))).alias("right_way"))


@query(
    "finite_status",
    f"WITH {EV} SELECT split, count(*) FILTER (y IS NOT NULL) AS n_used, count(*) FILTER (y IS NULL) AS n_dropped, CASE WHEN count(y)=0 THEN 'empty' WHEN count(DISTINCT y)<2 THEN 'skipped_one_class' ELSE 'ok' END AS status FROM ev GROUP BY split",
)
def finite_status(spark, sf_dir):
    used = F.count_if(F.col("y").isNotNull())
    status = F.when(used == 0, "empty").when(F.count_distinct("y") < 2, "skipped_one_class").otherwise("ok")
    return evaluation(spark, sf_dir).groupBy("split").agg(used.alias("n_used"), F.count_if(F.col("y").isNull()).alias("n_dropped"), status.alias("status"))


AVG_RANK = "(rank() OVER ({p} ORDER BY {c}) + (count(*) OVER ({pc} {c}) - 1)/2e0)"


@query(
    "spearman",
    f"WITH {EV}, r AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY n_chars) + (count(*) OVER (PARTITION BY split, n_chars)-1)/2e0 AS a, rank() OVER (PARTITION BY split ORDER BY s3) + (count(*) OVER (PARTITION BY split, s3)-1)/2e0 AS b FROM ev) SELECT split, count(*) AS n, round(corr(a,b),6) AS spearman FROM r GROUP BY split",
)
def spearman(spark, sf_dir):
    ev = evaluation(spark, sf_dir).withColumn("n_chars", F.col("n_chars").cast("double"))
    return me.spearman(ev, ["split"], "n_chars", "s3").select("split", "n", R6("spearman"))


@query(
    "level_shortcut",
    f"WITH {EV}, r AS (SELECT y, rank() OVER (PARTITION BY y ORDER BY n_chars) + (count(*) OVER (PARTITION BY y, n_chars)-1)/2e0 AS a, rank() OVER (PARTITION BY y ORDER BY s3) + (count(*) OVER (PARTITION BY y, s3)-1)/2e0 AS b FROM ev WHERE y IS NOT NULL) SELECT y, round(corr(a,b),6) AS rho, abs(corr(a,b)) > 0.3e0 AS flagged FROM r GROUP BY y",
)
def level_shortcut(spark, sf_dir):
    ev = evaluation(spark, sf_dir).filter("y is not null").withColumn("n_chars", F.col("n_chars").cast("double"))
    return me.spearman(ev, ["y"], "n_chars", "s3").select("y", F.round("spearman", 6).alias("rho"), (F.abs("spearman") > 0.3).alias("flagged"))


@query(
    "compare_scores",
    f"WITH {EV}, p AS (SELECT path, 1e0/(1e0+exp(-s2)) AS a, 1e0/(1e0+exp(-(s2+m3/50e0))) AS b FROM ev), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a)-1)/2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b)-1)/2e0 AS rb FROM p) SELECT count(*) AS n, round(corr(ra,rb),6) AS spearman, round(max(abs(a-b)),6) AS max_gap, round(avg(abs(a-b)),6) AS mean_gap, count(*) FILTER (abs(a-b)>0.01e0) AS over_01, count(*) FILTER (abs(a-b)>0.05e0) AS over_05 FROM r",
)
def compare_scores(spark, sf_dir):
    ev = evaluation(spark, sf_dir).select("path", (1 / (1 + F.exp(-F.col("s2")))).alias("a"), (1 / (1 + F.exp(-(F.col("s2") + F.col("m3") / 50.0)))).alias("b"))
    ranks = me.average_ranks(me.average_ranks(ev, [], "a", "ra"), [], "b", "rb")
    gap = F.abs(F.col("a") - F.col("b"))
    return ranks.agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("spearman"), F.round(F.max(gap), 6).alias("max_gap"), F.round(F.avg(gap), 6).alias("mean_gap"), F.count_if(gap > 0.01).alias("over_01"), F.count_if(gap > 0.05).alias("over_05"))


@query(
    "test_agreement",
    f"WITH {EV}, p AS (SELECT path, 1e0/(1e0+exp(-s2)) AS a, 1e0/(1e0+exp(-s3)) AS b FROM ev WHERE split='test') SELECT count(*) AS n, count(*) FILTER ((a>=0.5e0) <> (b>=0.5e0)) AS crossings FROM p WHERE a >= 0.001e0 AND b >= 0.001e0",
)
def test_agreement(spark, sf_dir):
    p = evaluation(spark, sf_dir).filter("split = 'test'").select((1 / (1 + F.exp(-F.col("s2")))).alias("a"), (1 / (1 + F.exp(-F.col("s3")))).alias("b")).filter("a >= 0.001D and b >= 0.001D")
    return p.agg(F.count("*").alias("n"), F.count_if((F.col("a") >= 0.5) != (F.col("b") >= 0.5)).alias("crossings"))


@query(
    "new_catches",
    f"WITH {EV} SELECT split, count(*) FILTER (y=1 AND s1 < 0 AND s2 >= 0) AS caught, count(*) FILTER (m3 < -3e0 AND s2 > 0) AS fires, round(avg(CASE WHEN (y=1 AND s1<0) OR (y=0 AND s1>=0) THEN ((y=1 AND s2>s1) OR (y=0 AND s2<s1))::INT END),6) AS corrective FROM ev WHERE y IS NOT NULL GROUP BY split",
)
def new_catches(spark, sf_dir):
    wrong = F.expr("(y = 1 and s1 < 0) or (y = 0 and s1 >= 0)")
    righted = F.expr("(y = 1 and s2 > s1) or (y = 0 and s2 < s1)").cast("int")
    return evaluation(spark, sf_dir).filter("y is not null").groupBy("split").agg(F.count_if(F.expr("y = 1 and s1 < 0 and s2 >= 0")).alias("caught"), F.count_if(F.expr("m3 < -3 and s2 > 0")).alias("fires"), F.round(F.avg(F.when(wrong, righted)), 6).alias("corrective"))


@query(
    "auc_by_fold",
    f"WITH {EV}, sc AS (SELECT fold, y, round(s2,9) AS score FROM ev WHERE split='inner_oof')" + DCF_SQL.format(k="fold", **BRIEF_SQL) + " SELECT fold, round(sum(pos*(nn-fp+neg/2e0))/nullif(max(np)*max(nn),0),6) AS auc FROM rocs GROUP BY fold",
)
def auc_by_fold(spark, sf_dir):
    s = evaluation(spark, sf_dir).filter("split = 'inner_oof'").select("fold", "y", F.round("s2", 9).alias("score"))
    return me.auc(s, ["fold"]).select("fold", R6("auc"))


@query("constant_baseline", f"WITH {EV} SELECT split, 1e0 AS min_dcf, count(*) AS n FROM ev WHERE y IS NOT NULL GROUP BY split HAVING count(DISTINCT y)=2")
def constant_baseline(spark, sf_dir):
    s = evaluation(spark, sf_dir).filter("y is not null").select("split", "y", F.lit(0.0).alias("score"))
    n = s.groupBy("split").agg(F.count("*").alias("n"))
    return me.min_dcf(s, ["split"]).filter("min_dcf is not null").join(n, "split").select("split", "min_dcf", "n")


SHIFTED_SQL = f"WITH {EV}, p AS (SELECT generator, avg(y) AS prior, count(*) AS n FROM ev WHERE y IS NOT NULL GROUP BY 1) SELECT generator, n, round(ln(4e0)-ln(prior/(1e0-prior)),6) AS brief, round(ln(0.25e0)-ln(prior/(1e0-prior)),6) AS averse FROM p WHERE prior>0 AND prior<1"


@query("bayes_thresholds", SHIFTED_SQL)
def bayes_thresholds(spark, sf_dir):
    """Where a log likelihood ratio has to be cut in each group, whose own share of positives is the prior."""
    p = evaluation(spark, sf_dir).filter("y is not null").groupBy("generator").agg(F.avg("y").alias("prior"), F.count("*").alias("n")).filter("prior > 0 and prior < 1")
    odds = F.log(F.col("prior") / (1 - F.col("prior")))
    cut = lambda c, name: F.round(math.log(c[0] / c[1]) - odds, 6).alias(name)
    return p.select("generator", "n", cut(BRIEF, "brief"), cut(AVERSE, "averse"))


@query(
    "perturb_cells",
    f"WITH {EV}, kinds AS (SELECT unnest(['none','shift','noise']) AS kind), sc AS (SELECT kind, y, round(s2 + CASE kind WHEN 'shift' THEN 0.5e0 WHEN 'noise' THEN s3/4e0 ELSE 0e0 END, 9) AS score FROM ev, kinds WHERE y IS NOT NULL)" + DCF_SQL.format(k="kind", **BRIEF_SQL) + " SELECT kind, round(min_dcf,6) AS min_dcf FROM dcf",
)
def perturb_cells(spark, sf_dir):
    kinds = F.explode(F.array(F.lit("none"), F.lit("shift"), F.lit("noise")))
    d = evaluation(spark, sf_dir).filter("y is not null").select("y", "s2", "s3", kinds.alias("kind"))
    moved = F.col("s2") + F.when(F.col("kind") == "shift", 0.5).when(F.col("kind") == "noise", F.col("s3") / 4.0).otherwise(0.0)
    return me.min_dcf(d.select("kind", "y", F.round(moved, 9).alias("score")), ["kind"]).select("kind", R6("min_dcf"))


@query(
    "latency_summary",
    "SELECT round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95, round(max(value),6) AS longest, round(avg(value),6) AS mean, quantile_cont(value,0.95) <= 750e0 AS passes FROM events",
)
def latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.agg(F.round(F.max("value"), 6).alias("longest"), F.round(F.avg("value"), 6).alias("mean"))
    q = quantiles(e, "value", {"p50": 0.5, "p95": 0.95})
    return d.join(q).select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "longest", "mean", (F.col("p95") <= 750).alias("passes"))
