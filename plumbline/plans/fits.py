"""Queries of fitted maps, novelty, bootstraps over two populations, attributions, checks before a run and alignment."""

from __future__ import annotations


from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.functions.prefix import quantiles
from plumbline.functions.scalars import BRIEF, bayes_threshold, config_hash
from plumbline.operators import fits
from plumbline.operators import features as fe
from plumbline.operators import folds as fo
from plumbline.operators import fusion as fu
from plumbline.operators import metrics as me
from plumbline.plans.fusion import BRIEF_SQL, DCF_SQL, WITH
from plumbline.plans.models import clips
from plumbline.sources.tables import EV, evaluation, long_scores, table

QUERIES, ORACLES = {}, {}
W = f"WITH {EV} "
JIT = "cast(('0x'||substr(sha1({}),1,16)) AS UBIGINT)::DOUBLE/18446744073709551616e0"
THRESHOLD = bayes_threshold(*BRIEF)
R6 = lambda c: F.round(c, 6).alias(c)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


PLATT_SQL = f"""WITH RECURSIVE {EV}, d AS (SELECT s2/2e0+s3 AS x, y::DOUBLE AS y FROM ev WHERE split='inner_oof'),
w AS (SELECT count(*)/(2e0*sum(y)) AS w1, count(*)/(2e0*sum(1e0-y)) AS w0, count(*) AS n FROM d),
t(k, a, b) AS (SELECT 0, 0e0, 0e0 UNION ALL SELECT k+1, a-(hbb*ga-hab*gb)/(haa*hbb-hab*hab), b-(haa*gb-hab*ga)/(haa*hbb-hab*hab) FROM
 (SELECT k, a, b, sum(g*x)+a*1e-6 AS ga, sum(g) AS gb, sum(h*x*x)+1e-6 AS haa, sum(h*x) AS hab, sum(h)+1e-12 AS hbb FROM
  (SELECT k, a, b, x, c*(p-y) AS g, c*p*(1e0-p) AS h FROM (SELECT k, a, b, x, y, CASE WHEN y=1 THEN w1 ELSE w0 END AS c, 1e0/(1e0+exp(-(a*x+b))) AS p FROM t, d, w WHERE k<15)) GROUP BY k, a, b))
SELECT round(a,5) AS a, round(b,5) AS b, n, 'ok' AS status FROM t, w WHERE k=15"""


@query("platt_fit", PLATT_SQL)
def platt_fit(spark, sf_dir):
    """The class-balanced map of a score to a probability, fitted on rows out of fold."""
    rows = evaluation(spark, sf_dir).filter("split = 'inner_oof'").select("y", (F.col("s2") / 2.0 + F.col("s3")).alias("score"))
    return fits.platt_fit(rows).select(F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), "n", "status")


@query("novelty_share")
def novelty_share(spark, sf_dir):
    """How much of the odd labels' vectors is like none of the even ones'."""
    e = table(spark, sf_dir, "embeddings").withColumn("fitted", F.col("label") % 2 == 0)
    return fits.novelty_share(e, "vec_id", "embedding", "fitted").select(R6("border"), "n", R6("novelty"))


def interval(d, value: str, draws: int):
    """95 % interval of a statistic over draws; undefined if more than a tenth of them have none."""
    q = quantiles(d, value, {"low": 0.025, "high": 0.975})
    enough = d.agg((F.count(value) >= 0.9 * draws).alias("enough"))
    return q.join(F.broadcast(enough)).select(*[F.when(F.col("enough"), F.round(c, 6)).alias(c) for c in ("low", "high")])  # one row


@query("mixed_bootstrap")
def mixed_bootstrap(spark, sf_dir, draws: int = 400):
    """Interval of the share of test rows that belong to a domain: test rows drawn one by one, the reference domains by speaker.

    A draw whose domains differ by less than .2 in hits has no share.
    """
    ev = evaluation(spark, sf_dir).withColumn("hit", (F.col("s2") + F.col("s3") > 0).cast("double"))
    known = ev.filter("y is not null").select("speaker", F.when(F.col("s3") >= 0, F.col("hit")).alias("tpr"), F.when(F.col("s3") < 0, F.col("hit")).alias("fpr"))
    q = fo.poisson_bootstrap(ev.filter("y is null"), "path", ["hit"], draws, seed=1).withColumnRenamed("hit", "q")
    both = q.join(fo.poisson_bootstrap(known, "speaker", ["tpr", "fpr"], draws, seed=2), "draw", "full")
    gap = F.col("tpr") - F.col("fpr")
    share = F.when(gap >= 0.2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("q") - F.col("fpr")) / gap)))
    return interval(both.select(share.alias("share")), "share", draws)


MIX = {"src0": 0.5, "src3": 0.3, "src6": 0.2}
QUOTA_SQL = W + f""", r AS (SELECT y AS label, source, path, row_number() OVER (PARTITION BY y, source ORDER BY doc_id) AS number FROM ev WHERE split='inner_oof' AND source IS NOT NULL),
p0 AS (SELECT label, source, count(*) AS n, CASE source WHEN 'src0' THEN 0.5e0 WHEN 'src3' THEN 0.3e0 WHEN 'src6' THEN 0.2e0 ELSE 0e0 END AS w FROM r GROUP BY ALL),
p1 AS (SELECT *, CASE WHEN sum(w) OVER l > 0 THEN w/sum(w) OVER l ELSE 1e0/count(*) OVER l END AS p FROM p0 WINDOW l AS (PARTITION BY label)),
p2 AS (SELECT *, sum(p) OVER w AS upto, lead(source) OVER w IS NULL AS last FROM p1 WHERE p>0 WINDOW w AS (PARTITION BY label ORDER BY source)),
s AS (SELECT i//16 AS step, i%16 AS place, (i%16>=8)::INT AS label FROM range(640) x(i)),
d AS (SELECT *, {JIT.format("'src:7:'||step||':'||place")} AS u, {JIT.format("'row:7:'||step||':'||place")} AS v FROM s)
SELECT d.step::INT AS step, d.place::INT AS place, d.label, p2.source, r.path FROM d JOIN p2 ON d.label=p2.label AND u>=upto-p AND u<CASE WHEN last THEN 2e0 ELSE upto END
JOIN r ON r.label=d.label AND r.source=p2.source AND r.number=floor(v*n)+1"""


@query("quota_batches", QUOTA_SQL)
def quota_batches(spark, sf_dir):
    """Forty training batches of sixteen: half of each label, sources by quota."""
    inner = evaluation(spark, sf_dir).filter("split = 'inner_oof'")
    b = fits.quota_batches(inner, "doc_id", "y", "source", MIX, 40, 16)
    return b.select("step", "place", "label", "source", F.concat(F.lit("doc/"), "key").alias("path"))


#: Two small trees whose inner nodes have values too. Fixed values.
TREES = [
    {"feature": [0, 1, 0, 0, 0], "threshold": [0.5, 0.0, 0, 0, 0], "left": [1, 3, -1, -1, -1], "right": [2, 4, -1, -1, -1], "value": [0.1, -0.05, 0.4, -0.2, 0.1], "missing_left": [True, False, True, True, True]},
    {"feature": [2, 0, 0], "threshold": [-1.0, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "value": [0.02, -0.3, 0.25], "missing_left": [True, True, True]},
]


@query("tree_attribution", W + "SELECT path, 0.12e0 AS bias, round(CASE WHEN s1<=0.5e0 THEN -0.15e0 ELSE 0.3e0 END,6) AS s1, round(CASE WHEN s1>0.5e0 THEN 0e0 WHEN s2<=0e0 THEN -0.15e0 ELSE 0.15e0 END,6) AS s2, round(CASE WHEN s3<=-1e0 THEN -0.32e0 ELSE 0.23e0 END,6) AS s3 FROM ev")
def tree_attribution(spark, sf_dir):
    """What each column adds to a tree score along the row's paths."""
    names = ["s1", "s2", "s3"]
    d = fo.tree_attribution(evaluation(spark, sf_dir), names, TREES, "path")
    return d.select("path", R6("bias"), *[F.round(F.element_at("parts", c), 6).alias(c) for c in names])


DRIFT_SQL = """WITH e AS (SELECT vec_id//8 AS clip, vec_id%8 AS k, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
u AS (SELECT clip, k, list_transform(e, lambda v: v/(sqrt(list_dot_product(e,e))+1e-9)) AS e FROM e),
p AS (SELECT a.clip, a.k, b.k AS l, list_dot_product(a.e,b.e) AS c FROM u a JOIN u b ON a.clip=b.clip AND a.k<b.k),
f AS (SELECT clip, k, min_by(c, l) AS c FROM p GROUP BY ALL),
s AS (SELECT clip, min(c) AS lo, avg(c) AS mean, stddev_pop(c) AS sd FROM p GROUP BY 1), n AS (SELECT clip, count(*)::INT AS n_windows FROM u GROUP BY 1)
SELECT n.clip, n_windows, round(coalesce(lo,1e0),6) AS cos_min, round(coalesce(mean,1e0),6) AS cos_mean, round(coalesce(sd,0e0),6) AS cos_std, round(coalesce((SELECT min(c) FROM f WHERE f.clip=n.clip),1e0),6) AS cos_adjacent_min, coalesce((lo<0.05e0)::INT,0)::DOUBLE AS drift FROM n LEFT JOIN s USING (clip)"""


@query("speaker_drift", DRIFT_SQL)
def speaker_drift(spark, sf_dir):
    """Whether the windows of one recording (eight vectors here) are of one speaker."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("clip"), (F.col("vec_id") % 8).alias("k"), "embedding")
    return fits.drift(e, "clip", "k", "embedding").select("clip", "n_windows", *[R6(c) for c in ("cos_min", "cos_mean", "cos_std", "cos_adjacent_min")], "drift")


@query("run_identity", "SELECT doc_id, sha256('{\"lang\":' || to_json(lang)::VARCHAR || ',\"n_chars\":' || n_chars || ',\"source\":' || to_json(source)::VARCHAR || '}') AS identity FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def run_identity(spark, sf_dir):
    """Identity of a run's settings: the hash of their JSON by sorted names."""
    d = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    return d.select("doc_id", config_hash(source=F.col("source"), n_chars=F.col("n_chars"), lang=F.col("lang")).alias("identity"))


MASK_SQL = W + """, sc AS (SELECT candidate, split, y, CASE WHEN hash_ NOT IN (0,1) THEN round(score,9) END AS score FROM (SELECT *, substr(path,5)::BIGINT%11 AS hash_ FROM scores) WHERE y IS NOT NULL)
, n AS (SELECT candidate, split, count(*) AS n, count(*) FILTER (score IS NULL) AS n_masked, min(y) FILTER (score IS NOT NULL) <> max(y) FILTER (score IS NOT NULL) AS two FROM sc GROUP BY ALL), k AS (SELECT * FROM sc WHERE score IS NOT NULL)""" + DCF_SQL.format(k="candidate, split", **BRIEF_SQL).replace("FROM sc ", "FROM k ") + """, a AS (SELECT candidate, split, round(sum(pos*(nn-fp+neg/2e0))/nullif(max(np)*max(nn),0),6) AS auc FROM rocs GROUP BY ALL)
SELECT n.candidate, n.split, n.n, n_masked, CASE WHEN n.n=n_masked THEN 'empty' WHEN two THEN 'ok' ELSE 'one class' END AS status, auc, round(min_dcf,6) AS min_dcf FROM n LEFT JOIN a USING (candidate, split) LEFT JOIN dcf USING (candidate, split)"""


@query("masked_report", MASK_SQL)
def masked_report(spark, sf_dir):
    """Metrics of finite scores, how many rows were left out, and why there is no figure."""
    rest = F.substring("path", 5, 20).cast("long") % 11
    score = F.when(rest == 0, F.lit(float("nan"))).when(rest > 1, F.round("score", 9))
    rows = long_scores(evaluation(spark, sf_dir)).filter("y is not null").withColumn("score", score)
    return me.masked_report(rows, ["candidate", "split"]).select("candidate", "split", "n", "n_masked", "status", R6("auc"), R6("min_dcf"))


COMMON_SQL = W + """, own AS (SELECT candidate, split, path, y, round(score,9) AS score FROM scores WHERE y IS NOT NULL AND NOT ((candidate='s2' AND substr(path,5)::BIGINT%7=0) OR (candidate='s3' AND substr(path,5)::BIGINT%5=0))),
good AS (SELECT candidate FROM own WHERE split='inner_oof' GROUP BY 1 HAVING avg(score) FILTER (y=1) >= avg(score) FILTER (y=0)),
kept AS (SELECT * FROM own WHERE candidate IN (SELECT candidate FROM good)), shared AS (SELECT path FROM kept GROUP BY 1 HAVING count(*)=(SELECT count(*) FROM good)),
sc AS (SELECT 'own' AS rows, candidate, split, y, score FROM kept UNION ALL SELECT 'common', candidate, split, y, score FROM kept WHERE path IN (SELECT path FROM shared))""" + DCF_SQL.format(k="rows, candidate, split", **BRIEF_SQL) + " SELECT rows, candidate, split, round(min_dcf,6) AS min_dcf FROM dcf"


@query("common_rows_recompared", COMMON_SQL)
def common_rows_recompared(spark, sf_dir):
    """Candidates that point the right way, scored on their own rows and again on the rows that all of them have."""
    n = F.substring("path", 5, 20).cast("long")
    lost = ((F.col("candidate") == "s2") & (n % 7 == 0)) | ((F.col("candidate") == "s3") & (n % 5 == 0))
    own = long_scores(evaluation(spark, sf_dir)).filter(F.col("y").isNotNull() & ~lost).select("candidate", "split", "path", "y", F.round("score", 9).alias("score"))
    mean = lambda label: F.avg(F.when(F.col("y") == label, F.col("score")))
    good = own.filter("split = 'inner_oof'").groupBy("candidate").agg((mean(1) >= mean(0)).alias("ok")).filter("ok").select("candidate")
    kept = settled(own.join(F.broadcast(good), "candidate"))  # three candidates at most
    wanted = kept.agg(F.count_distinct("candidate").alias("wanted"))
    shared = kept.groupBy("path").agg(F.count("*").alias("n")).join(F.broadcast(wanted)).filter("n = wanted").select("path")  # one row
    both = kept.withColumn("rows", F.lit("own")).unionByName(kept.join(shared, "path", "left_semi").withColumn("rows", F.lit("common")))
    return me.min_dcf(both, ["rows", "candidate", "split"]).select("rows", "candidate", "split", R6("min_dcf"))


GATE3_SQL = W + ", sc AS (SELECT candidate, split, y, round(score,9) AS score FROM scores WHERE y IS NOT NULL)" + DCF_SQL.format(k="candidate, split", **BRIEF_SQL) + f""", c AS (SELECT candidate, max(min_dcf) FILTER (split='holdout') AS holdout, max(min_dcf) FILTER (split='inner_oof') AS inner_ FROM dcf GROUP BY 1),
f AS (SELECT candidate, avg((score>={THRESHOLD!r}::DOUBLE)::INT) AS p_fa FROM sc WHERE split='itw' AND y=0 GROUP BY 1)
SELECT n.candidate, n.holdout<o.holdout AS holdout, n.inner_<o.inner_ AS inner_oof, nf.p_fa<f0.p_fa AS wild, n.holdout<o.holdout AND n.inner_<o.inner_ AND nf.p_fa<f0.p_fa AS passes FROM c n JOIN f nf USING (candidate), c o JOIN f f0 USING (candidate) WHERE o.candidate='s1' AND n.candidate<>'s1'"""


@query("three_way_gate", GATE3_SQL)
def three_way_gate(spark, sf_dir):
    """A new detector has to beat the first one on the holdout, out of fold, and in false alarms in the wild."""
    rows = settled(long_scores(evaluation(spark, sf_dir)).filter("y is not null").select("candidate", "split", "y", F.round("score", 9).alias("score")))
    cost = me.min_dcf(rows, ["candidate", "split"]).groupBy("candidate").pivot("split", ["holdout", "inner_oof"]).agg(F.max("min_dcf"))
    alarms = rows.filter("split = 'itw' and y = 0").groupBy("candidate").agg(F.avg((F.col("score") >= THRESHOLD).cast("int")).alias("wild"))
    c = settled(cost.join(alarms, "candidate"))
    names = ["holdout", "inner_oof", "wild"]
    old = c.filter("candidate = 's1'").select(*[F.col(k).alias(f"old_{k}") for k in names])
    beats = [(F.col(k) < F.col(f"old_{k}")).alias(k) for k in names]
    won = c.filter("candidate <> 's1'").join(F.broadcast(old)).select("candidate", *beats)  # one row
    return won.withColumn("passes", F.expr(" and ".join(names)))


@query("clip_alignment")
def clip_alignment(spark, sf_dir):
    return fe.alignment(clips(spark, sf_dir), ["none", "shift1", "noise20"]).select("path", "kind", "lag", F.round("snr_db", 3).alias("snr_db"))


@query("sidecar", WITH + "SELECT path AS filename, n_chars>=300 AS is_speech, round(s1,6) AS s1, round(s2,6) AS s2, round(s3,6) AS s3, round(m3,6) AS m3, round(fused,6) AS fused, round(p_fused,6) AS p_fused FROM probs")
def sidecar(spark, sf_dir):
    """Flat rows of the analysis documents."""
    d = fu.decided(evaluation(spark, sf_dir))
    return d.select(F.col("path").alias("filename"), "is_speech", *[R6(c) for c in ("s1", "s2", "s3", "m3", "fused", "p_fused")])


@query("corpus_probe")
def corpus_probe(spark, sf_dir):
    """Boosted trees that tell two pools apart, and where the rows of neither land."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    e = e.select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") == 2).cast("double").alias("pool"))
    model = GBTClassifier(featuresCol="features", labelCol="pool", maxIter=10, maxDepth=3, seed=0).fit(e.filter("label in (1, 2)"))
    p = model.transform(e).withColumn("p", vector_to_array("probability")[1])
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg((F.col("p") >= 0.5).cast("int")), 4).alias("share"))
