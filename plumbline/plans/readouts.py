"""Queries that put metrics, fusion and lookups together: read-outs, comparisons, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import BRIEF, FAILED, determinate, jitter, sigmoid
from plumbline.operators import draws, expect
from plumbline.operators import fusion as fu
from plumbline.operators import metrics as me
from plumbline.operators import relations
from plumbline.plans.fusion import BRIEF_SQL, DCF_SQL, RANKED
from plumbline.sources.tables import EV, evaluation, long_scores, table

QUERIES, ORACLES = {}, {}
W = f"WITH {EV} "
R6 = lambda c: F.round(c, 6).alias(c)
RULES = {"fuse_zmean": "round((z1+z2+z3)/3e0,6)", "fuse_stack": "round(0.8e0*z1+0.5e0*z2-0.3e0*z3+0.1e0,6)", "fuse_rankmean": "round((r1+r2+r3)/3e0,6)"}
Z = ", f AS (SELECT avg(s1) m1, stddev_pop(s1) d1, avg(s2) m2, stddev_pop(s2) d2, avg(s3) m3_, stddev_pop(s3) d3 FROM ev WHERE split='inner_oof'), z AS (SELECT ranked.*, (s1-m1)/d1 AS z1, (s2-m2)/d2 AS z2, (s3-m3_)/d3 AS z3 FROM ranked, f)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def both_scales(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    return fu.standardised(fu.ranked(ev, ev.filter("split = 'inner_oof'")))


for rule, sql in RULES.items():

    @query(rule, f"WITH {EV}{RANKED}{Z} SELECT path, {sql} AS score FROM z")
    def fuse(spark, sf_dir, rule=rule):
        z, r = [F.col(f"z_{c}") for c in fu.DETECTORS], [F.col(f"r_{c}") for c in fu.DETECTORS]
        score = {"fuse_zmean": (z[0] + z[1] + z[2]) / 3.0, "fuse_stack": 0.8 * z[0] + 0.5 * z[1] - 0.3 * z[2] + 0.1, "fuse_rankmean": (r[0] + r[1] + r[2]) / 3.0}[rule]
        return both_scales(spark, sf_dir).select("path", F.round(score, 6).alias("score"))


@query("fuse_minmax", W + "SELECT path, round(least(s1,s2,s3),6) AS lowest, round(greatest(s1,s2,s3),6) AS highest FROM ev")
def fuse_minmax(spark, sf_dir):
    return evaluation(spark, sf_dir).select("path", F.round(F.least("s1", "s2", "s3"), 6).alias("lowest"), F.round(F.greatest("s1", "s2", "s3"), 6).alias("highest"))


@query("suppress", f"WITH {EV}{RANKED} SELECT path, round(fused,6) AS fused, m3 < -3e0 AND base > 0.5e0 AS fires FROM fused")
def suppress(spark, sf_dir):
    d = fu.fused(evaluation(spark, sf_dir))
    return d.select("path", R6("fused"), ((F.col("m3") < fu.E_THRESHOLD) & (F.col("base") > fu.E_FLOOR)).alias("fires"))


@query("tier_fires", f"WITH {EV}{RANKED} SELECT y, count(*) FILTER (m3 < -6e0 AND base > 0.5e0) AS deep, count(*) FILTER (m3 < -3e0 AND base > 0.5e0) AS any_ FROM based GROUP BY y")
def tier_fires(spark, sf_dir):
    d = fu.fused(evaluation(spark, sf_dir))
    return d.groupBy("y").agg(F.count_if(F.expr("m3 < -6 and base > 0.5D")).alias("deep"), F.count_if(F.expr("m3 < -3 and base > 0.5D")).alias("any_"))


@query("zscore_fit", W + "SELECT split, round(avg(s1),6) AS mean, round(stddev_pop(s1),6) AS std FROM ev GROUP BY split")
def zscore_fit(spark, sf_dir):
    return evaluation(spark, sf_dir).groupBy("split").agg(F.round(F.avg("s1"), 6).alias("mean"), F.round(F.stddev_pop("s1"), 6).alias("std"))


@query("agreement", W + "SELECT split, count(*) AS n, round(corr(a,b),6) AS rho FROM (SELECT split, rank() OVER (PARTITION BY split ORDER BY s2) AS a, rank() OVER (PARTITION BY split ORDER BY m3) AS b FROM ev WHERE split IN ('holdout','test')) GROUP BY split")
def agreement(spark, sf_dir):
    ev = evaluation(spark, sf_dir).filter("split in ('holdout', 'test')")
    return me.spearman(ev, ["split"], "s2", "m3").select("split", "n", F.round("spearman", 6).alias("rho"))


@query("aug_rates", W + "SELECT source, y, round(avg((s2>1)::INT),6) AS rate, count(*) AS n FROM ev GROUP BY ALL")
def aug_rates(spark, sf_dir):
    return evaluation(spark, sf_dir).groupBy("source", "y").agg(F.round(F.avg((F.col("s2") > 1).cast("int")), 6).alias("rate"), F.count("*").alias("n"))


VARIANTS = W + ", u AS (SELECT generator, round(quantile_cont(s1,0.5),9) AS a, round(quantile_cont(s2,0.5),9) AS b, count(*) AS n FROM ev GROUP BY 1), g AS (SELECT u.generator, u.n, abs(u.a-k.a) AS ga, abs(u.b-k.b) AS gb, abs(u.a-k.a)+abs(u.b-k.b) AS distance FROM u, (SELECT * FROM u WHERE generator='en') k)"


def variants(spark, sf_dir):
    u = evaluation(spark, sf_dir).groupBy("generator").agg(F.round(F.percentile("s1", 0.5), 9).alias("a"), F.round(F.percentile("s2", 0.5), 9).alias("b"), F.count("*").alias("n"))
    base = u.filter("generator = 'en'").select(F.col("a").alias("a0"), F.col("b").alias("b0"))
    gap = {"ga": F.abs(F.col("a") - F.col("a0")), "gb": F.abs(F.col("b") - F.col("b0"))}
    return u.join(F.broadcast(base)).withColumns(gap).withColumn("distance", F.col("ga") + F.col("gb"))


@query("variant_table", VARIANTS + " SELECT generator, n, round(ga,6) AS ga, round(gb,6) AS gb, round(distance,6) AS distance FROM g")
def variant_table(spark, sf_dir):
    return variants(spark, sf_dir).select("generator", "n", R6("ga"), R6("gb"), R6("distance"))


MATCH_SQL = W + """, l AS (SELECT source AS variant, split='test' AS target, unnest(['s1','s2','s3','m3']) AS stat, unnest([s1,s2,s3,m3]) AS v FROM ev),
t AS (SELECT stat, quantile_cont(v,0.5) AS goal, quantile_cont(v,0.75)-quantile_cont(v,0.25) AS width FROM l WHERE target GROUP BY 1), o AS (SELECT variant, stat, quantile_cont(v,0.5) AS m FROM l WHERE NOT target AND variant IS NOT NULL GROUP BY ALL),
g AS (SELECT variant, count(*) FILTER (width>1e-9) AS n_stats, avg(abs(m-goal)/width) FILTER (width>1e-9) AS distance, max(abs(m-goal)) FILTER (stat='s3') AS h0, max(abs(m-goal)) FILTER (stat='m3') AS h1 FROM o JOIN t USING (stat) GROUP BY 1)
SELECT g.variant, g.n_stats, round(g.distance,6) AS distance, g.distance<=0.8e0*k.distance AS nearer, g.h0<k.h0 AND g.h1<k.h1 AS holes_nearer, g.distance<=0.8e0*k.distance AND g.h0<k.h0 AND g.h1<k.h1 AS matches, row_number() OVER (ORDER BY round(g.distance,12), g.variant)::INT AS place FROM g, g k WHERE k.variant='src0' AND g.variant NOT IN ('src0','src1')"""


@query("codec_match", MATCH_SQL)
def codec_match(spark, sf_dir):
    """Which source looks like the test rows: nearer than the baseline by a fifth over all statistics, and in each of two."""
    made = relations.matched_variants(evaluation(spark, sf_dir), "source", ["s1", "s2", "s3", "m3"], F.col("split") == "test", ["s3", "m3"], "src0", ["src1"])
    return made.withColumn("distance", F.round("distance", 6))


@query("collect_logits", "SELECT conv_id, max(length(text)) FILTER (role='user' AND turn=0) AS user_chars, max(length(text)) FILTER (role='assistant' AND turn=1) AS assistant_chars FROM conversations GROUP BY 1")
def collect_logits(spark, sf_dir):
    """The largest feature of each name's entries at its turn; entries are not gathered."""

    def found(name: str, turn: int):
        return F.max(F.when((F.col("role") == name) & (F.col("turn") == turn), F.length("text")))

    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(found("user", 0).alias("user_chars"), found("assistant", 1).alias("assistant_chars"))


@query("role_map", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'evidence' WHEN 'assistant' THEN 'fused' WHEN 'system' THEN 'gate' END AS part FROM conversations")
def role_map(spark, sf_dir):
    parts = F.create_map(*[F.lit(x) for x in ("user", "evidence", "assistant", "fused", "system", "gate")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.try_element_at(parts, F.col("role")).alias("part"))


@query("corrective_share", W + "SELECT generator, round(avg(((y=1 AND s2>s1) OR (y=0 AND s2<s1))::INT),6) AS share, count(*) AS n FROM ev WHERE (y=1 AND s1<0) OR (y=0 AND s1>=0) GROUP BY 1")
def corrective_share(spark, sf_dir):
    wrong = evaluation(spark, sf_dir).filter("(y = 1 and s1 < 0) or (y = 0 and s1 >= 0)")
    right = F.expr("(y = 1 and s2 > s1) or (y = 0 and s2 < s1)").cast("int")
    return wrong.groupBy("generator").agg(F.round(F.avg(right), 6).alias("share"), F.count("*").alias("n"))


SC = f"WITH {EV}, sc AS (SELECT candidate, split, y, round(score, 9) AS score FROM scores WHERE y IS NOT NULL)"
INNER = ", p AS (SELECT candidate, score, row_number() OVER (PARTITION BY candidate ORDER BY round(cost,12), score) AS rn FROM costs WHERE split='inner_oof'), t AS (SELECT candidate, score AS threshold FROM p WHERE rn=1)"


def scores(spark, sf_dir):
    return long_scores(evaluation(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("threshold_inner", SC + DCF_SQL.format(k="candidate, split", **BRIEF_SQL) + INNER + " SELECT * FROM t")
def threshold_inner(spark, sf_dir):
    return me.pick_threshold(scores(spark, sf_dir).filter("split = 'inner_oof'"), ["candidate"]).select("candidate", "threshold")


@query("miss_recovery", SC + DCF_SQL.format(k="candidate, split", **BRIEF_SQL) + INNER + ", m AS (SELECT path FROM ev, t WHERE t.candidate='s1' AND y=1 AND round(s1,9) < threshold) SELECT 's2' AS candidate, count(*) AS misses, count(*) FILTER (round(s2,9) >= (SELECT threshold FROM t WHERE candidate='s2')) AS recovered FROM ev WHERE path IN (SELECT path FROM m)")
def miss_recovery(spark, sf_dir):
    t = threshold_inner(spark, sf_dir).groupBy().pivot("candidate", ["s1", "s2"]).agg(F.max("threshold")).toDF("t1", "t2")
    missed = evaluation(spark, sf_dir).join(F.broadcast(t)).filter(F.expr("y = 1 and round(s1, 9) < t1"))
    return missed.agg(F.count("*").alias("misses"), F.count_if(F.expr("round(s2, 9) >= t2")).alias("recovered")).select(F.lit("s2").alias("candidate"), "misses", "recovered")


READ = SC + DCF_SQL.format(k="candidate, split", **BRIEF_SQL) + INNER + ", au AS (SELECT candidate, split, sum(pos*(nn-fp+neg/2e0))/(max(np)*max(nn)) AS auc FROM rocs GROUP BY ALL), ra AS (SELECT sc.candidate, sc.split, avg((score>=threshold)::INT) FILTER (y=0) AS p_fa, avg((score<threshold)::INT) FILTER (y=1) AS p_miss FROM sc JOIN t USING (candidate) GROUP BY ALL) SELECT candidate, split, round(auc,6) AS auc, round(min_dcf,6) AS min_dcf, round(p_fa,6) AS p_fa, round(p_miss,6) AS p_miss FROM au JOIN dcf USING (candidate, split) JOIN ra USING (candidate, split)"


def readouts(s, keys):
    t = me.pick_threshold(s.filter("split = 'inner_oof'"), ["candidate"]).select("candidate", "threshold")
    at = me.cost_at(s.filter("y is not null").join(F.broadcast(t), "candidate"), keys, F.col("threshold"), BRIEF)
    return me.auc(s, keys).join(me.min_dcf(s, keys), keys).join(at, keys).select(*keys, R6("auc"), R6("min_dcf"), R6("p_fa"), R6("p_miss"))


@query("split_readouts", READ)
def split_readouts(spark, sf_dir):
    return readouts(scores(spark, sf_dir), ["candidate", "split"])


@query("stress_readout", READ + " WHERE split='itw'")
def stress_readout(spark, sf_dir):
    return readouts(scores(spark, sf_dir), ["candidate", "split"]).filter("split = 'itw'")


@query(
    "refit_compare",
    f"WITH {EV}{RANKED}, sc AS (SELECT 'with_s3' AS rule, split, y, round(0.6e0*r1+0.2e0*r2+0.2e0*r3,9) AS score FROM ranked UNION ALL SELECT 's2_twice', split, y, round(0.6e0*r1+0.4e0*r2,9) FROM ranked)" + DCF_SQL.format(k="rule, split", **BRIEF_SQL) + " SELECT split, round(max(min_dcf) FILTER (rule='s2_twice')-max(min_dcf) FILTER (rule='with_s3'),6) AS change FROM dcf GROUP BY split",
)
def refit_compare(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    d = fu.ranked(ev, ev.filter("split = 'inner_oof'"))
    wide = d.select("split", "y", F.round(fu.blend(), 9).alias("with_s3"), F.round(fu.blend({"s1": 0.6, "s2": 0.4}), 9).alias("s2_twice"))
    cells = me.min_dcf(wide.unpivot(["split", "y"], ["with_s3", "s2_twice"], "rule", "score"), ["rule", "split"])
    p = cells.groupBy("split").pivot("rule", ["with_s3", "s2_twice"]).agg(F.max("min_dcf"))
    return p.select("split", F.round(F.col("s2_twice") - F.col("with_s3"), 6).alias("change"))


@query("verdict_guard", W + ", m AS (SELECT generator, avg(s2) FILTER (y=1) AS p, avg(s2) FILTER (y=0) AS n, count(y) AS k FROM ev GROUP BY 1) SELECT generator, CASE WHEN p IS NULL OR n IS NULL OR k < 20 THEN 'inconclusive' WHEN p-n > 1e0 THEN 'memorised' ELSE 'clear' END AS reading FROM m")
def verdict_guard(spark, sf_dir):
    m = evaluation(spark, sf_dir).groupBy("generator").agg(F.avg(F.when(F.col("y") == 1, F.col("s2"))).alias("p"), F.avg(F.when(F.col("y") == 0, F.col("s2"))).alias("n"), F.count("y").alias("k"))
    return m.select("generator", F.when(F.expr("p is null or n is null or k < 20"), "inconclusive").when(F.col("p") - F.col("n") > 1, "memorised").otherwise("clear").alias("reading"))


@query("template_order", W + "SELECT row_number() OVER (ORDER BY doc_id)-1 AS ord, path AS filename FROM ev WHERE y IS NULL")
def template_order(spark, sf_dir):
    """The test rows numbered in their order, over ranges."""
    return draws.numbered(evaluation(spark, sf_dir).filter("y is null"), "doc_id", name="ord").select("ord", F.col("path").alias("filename"))


TEMPLATE_SQL = """WITH t AS (SELECT row_number() OVER (ORDER BY vec_id)-1 AS ord, vec_id, 'v'||vec_id AS filename FROM embeddings), s AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE*((i%5)-2)))-0.25e0 AS z FROM embeddings WHERE vec_id%9<>4)
SELECT ord, filename, round(CASE WHEN z IS NULL THEN 0.0001e0*cast(('0x'||substr(sha1(filename),1,16)) AS UBIGINT)::DOUBLE/18446744073709551616e0 ELSE 0.001e0+0.999e0/(1e0+exp(-z)) END,6) AS score, CASE WHEN z IS NULL THEN 'missing' ELSE '' END AS flag FROM t LEFT JOIN s USING (vec_id)"""


@query("template_scores", TEMPLATE_SQL)
def template_scores(spark, sf_dir):
    """A submission from stored embeddings: a linear probe's posterior for each template row, pinned where the store lacks it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    weights = F.transform(F.sequence(F.lit(1), F.greatest(F.size("e"), F.lit(1))), lambda i: ((i % 5) - 2).cast("double"))
    z = F.aggregate(F.zip_with("e", weights, lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b) - 0.25
    stored = e.filter("vec_id % 9 <> 4").select("vec_id", z.alias("z"))
    t = draws.numbered(e.select("vec_id"), "vec_id", name="ord").withColumn("filename", F.concat(F.lit("v"), "vec_id"))
    score = F.when(F.col("z").isNull(), FAILED * jitter(F.col("filename"))).otherwise(determinate(sigmoid(F.col("z"))))
    return t.join(stored, "vec_id", "left").select("ord", "filename", F.round(score, 6).alias("score"), F.when(F.col("z").isNull(), "missing").otherwise("").alias("flag"))


@query("pcm_diff", "WITH a AS (SELECT doc_id, CASE WHEN doc_id%10=9 THEN NULL ELSE sha256(text) END AS sha FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id%4=3 THEN NULL ELSE sha256(text) END AS sha FROM documents) SELECT doc_id, CASE WHEN a.sha IS NULL THEN 'extra' WHEN b.sha IS NULL THEN 'missing' WHEN a.sha=b.sha THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b USING (doc_id)")
def pcm_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    a = d.withColumn("sha", F.when(F.col("doc_id") % 10 != 9, F.col("sha")))
    return expect.compared(a, d.withColumn("sha", F.when(F.col("doc_id") % 4 != 3, F.col("sha"))), "doc_id", "sha")


@query(
    "offset_slopes",
    "WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events), s AS (SELECT user_id, pos, regr_slope(value,pos) OVER w AS slope, count(*) OVER w AS n, value < lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS falls FROM x WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) SELECT user_id, pos, round(slope,5) AS slope FROM s WHERE n=12 AND falls",
)
def offset_slopes(spark, sf_dir):
    from pyspark.sql import Window

    from plumbline.operators.frames import positioned

    x = positioned(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    by = Window.partitionBy("user_id").orderBy("pos")
    w = by.rowsBetween(0, 11)
    d = x.withColumns({"slope": F.regr_slope("value", "pos").over(w), "n": F.count("*").over(w), "falls": F.col("value") < F.lag("value").over(by)})
    return d.filter("n = 12 and falls").select("user_id", "pos", F.round("slope", 5).alias("slope"))
