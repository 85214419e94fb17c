"""Queries of row rules, adoption rules, attributions and seeded plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import BRIEF, bayes_threshold, jitter
from plumbline.operators import fusion as fu
from plumbline.operators import metrics as me
from plumbline.operators.relations import capped
from plumbline.plans.fusion import BRIEF_SQL, DCF_SQL, WITH
from plumbline.plans.metrics import EER_SQL, SC
from plumbline.sources.tables import EV, evaluation, long_scores, table

QUERIES, ORACLES = {}, {}
W = f"WITH {EV} "
JIT = "cast(('0x'||substr(sha1({}),1,16)) AS UBIGINT)::DOUBLE/18446744073709551616e0"
THRESHOLD = bayes_threshold(*BRIEF)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("decision_logit", W + f"SELECT path, round(s2-({THRESHOLD!r}::DOUBLE),6) AS decision, s2 >= {THRESHOLD!r}::DOUBLE AS positive FROM ev")
def decision_logit(spark, sf_dir):
    """A log likelihood ratio less the Bayes threshold: positive above zero."""
    ev = evaluation(spark, sf_dir)
    return ev.select("path", F.round(F.col("s2") - THRESHOLD, 6).alias("decision"), (F.col("s2") >= THRESHOLD).alias("positive"))


@query("ok_rows", W + "SELECT path, round(s1,6) AS s1 FROM ev WHERE coalesce(CASE WHEN n_chars<50 THEN 'decode_error' WHEN m3>5.5e0 THEN 'score_error' END,'')=''")
def ok_rows(spark, sf_dir):
    flag = F.when(F.col("n_chars") < 50, "decode_error").when(F.col("m3") > 5.5, "score_error")
    return evaluation(spark, sf_dir).filter(F.coalesce(flag, F.lit("")) == "").select("path", F.round("s1", 6).alias("s1"))


@query("gate_default", "SELECT d.doc_id, coalesce(l.flag,true) AS is_speech FROM documents d LEFT JOIN (SELECT doc_id, max(quality)=1 AS flag FROM labels GROUP BY 1) l USING (doc_id)")
def gate_default(spark, sf_dir):
    """A gate that failed or did not run gates nothing."""
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("flag"))
    d = table(spark, sf_dir, "documents").select("doc_id").join(flags, "doc_id", "left")
    return d.select("doc_id", F.coalesce("flag", F.lit(True)).alias("is_speech"))


@query("core_holdout", W + "SELECT path, fold FROM ev WHERE split='holdout' AND y IS NOT NULL AND generator IN ('en','de')")
def core_holdout(spark, sf_dir):
    """Rows to validate on: the holdout of the core scope, labelled."""
    return evaluation(spark, sf_dir).filter("split = 'holdout' and y is not null and generator in ('en', 'de')").select("path", "fold")


CI = "1.96e0*stddev_samp(s2)/sqrt(count(*))"


@query("crossover", W + f"SELECT generator, CASE WHEN avg(s2)-{CI}>0e0 THEN 'above' WHEN avg(s2)+{CI}<0e0 THEN 'below' ELSE 'open' END AS reading, round(avg(s2)-{CI},6) AS low, round(avg(s2)+{CI},6) AS high FROM ev GROUP BY 1")
def crossover(spark, sf_dir):
    """A mean is above or below a line only if its whole interval is."""
    half = 1.96 * F.stddev_samp("s2") / F.sqrt(F.count("*"))
    d = evaluation(spark, sf_dir).groupBy("generator").agg((F.avg("s2") - half).alias("low"), (F.avg("s2") + half).alias("high"))
    reading = F.when(F.col("low") > 0, "above").when(F.col("high") < 0, "below").otherwise("open")
    return d.select("generator", reading.alias("reading"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


PICK_SQL = SC + DCF_SQL.format(k="candidate, split", **BRIEF_SQL) + EER_SQL + """ SELECT d.candidate, round(min_dcf,6) AS min_dcf, round((fnr+fpr)/2e0,6) AS eer FROM dcf d JOIN e2 e ON d.candidate=e.candidate AND d.split=e.split AND e.rn=1
WHERE d.split='inner_oof' ORDER BY round(min_dcf,9), round((fnr+fpr)/2e0,9), d.candidate LIMIT 1"""


@query("model_selection", PICK_SQL)
def model_selection(spark, sf_dir):
    """The candidate with the least cost out of fold, then the least equal error rate, then the first name."""
    inner = long_scores(evaluation(spark, sf_dir)).filter("split = 'inner_oof'").withColumn("score", F.round("score", 9))
    both = me.min_dcf(inner, ["candidate"]).join(me.eer(inner, ["candidate"]), "candidate")
    best = F.min(F.struct(F.round("min_dcf", 9).alias("cost"), F.round("eer", 9).alias("eer"), F.col("candidate").alias("name"))).alias("b")
    return both.agg(best).select(F.col("b.name").alias("candidate"), F.round("b.cost", 6).alias("min_dcf"), F.round("b.eer", 6).alias("eer"))


@query("mean_posterior", WITH + "SELECT split, count(*) AS n, round(avg(p_fused),6) AS mean_p FROM probs GROUP BY 1")
def mean_posterior(spark, sf_dir):
    """Estimated share of positives: the mean posterior."""
    return fu.fused(evaluation(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("p_fused"), 6).alias("mean_p"))


@query("feature_stats", "SELECT dim, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(0,len(embedding)))::INT AS dim FROM embeddings WHERE label=0) GROUP BY 1")
def feature_stats(spark, sf_dir):
    """Mean and deviation of each feature over the negative class."""
    e = table(spark, sf_dir, "embeddings").filter("label = 0").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v"))
    return e.groupBy("dim").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


ATTRIBUTION_SQL = "SELECT vec_id, rn::INT AS place, dim, round(c,6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, dim) AS rn FROM (SELECT vec_id, dim, v*((dim*7)%11-5)/10e0 AS c FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0,len(embedding)))::INT AS dim FROM embeddings))) WHERE rn<=3"


@query("linear_attribution", ATTRIBUTION_SQL)
def linear_attribution(spark, sf_dir):
    """The three features that move a linear score most: value times coefficient, in the row, without a shuffle."""
    parts = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.struct((-F.abs(c := v * ((i * 7) % 11 - 5) / 10.0)).alias("size"), i.alias("dim"), c.alias("c")))
    top = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice(F.array_sort(parts), 1, 3)).alias("at", "top"))
    return top.select("vec_id", (F.col("at") + 1).alias("place"), "top.dim", F.round("top.c", 6).alias("contribution"))


ADOPT_SQL = SC + DCF_SQL.format(k="candidate, split", **BRIEF_SQL) + """, c AS (SELECT candidate, max(min_dcf) FILTER (split='itw') AS itw, max(min_dcf) FILTER (split='holdout') AS holdout, max(min_dcf) FILTER (split='inner_oof') AS inner_ FROM dcf GROUP BY 1)
SELECT n.candidate, round(n.itw-o.itw,9) <= -0.01e0 AND round(n.holdout-o.holdout,9) <= 0.01e0 AND round(n.inner_-o.inner_,9) <= 0.01e0 AS adopt FROM c n, c o WHERE o.candidate='s1' AND n.candidate<>'s1'"""


@query("adoption_rule", ADOPT_SQL)
def adoption_rule(spark, sf_dir):
    """A candidate replaces the first one if it gains .01 in the wild and loses at most .01 elsewhere."""
    rows = long_scores(evaluation(spark, sf_dir)).filter("split <> 'test'").withColumn("score", F.round("score", 9))
    cells = me.min_dcf(rows, ["candidate", "split"]).groupBy("candidate").pivot("split", ["itw", "holdout", "inner_oof"]).agg(F.max("min_dcf"))
    old = cells.filter("candidate = 's1'").select(*[F.col(c).alias(f"old_{c}") for c in ("itw", "holdout", "inner_oof")])
    gain = lambda c: F.round(F.col(c) - F.col(f"old_{c}"), 9)
    adopt = (gain("itw") <= -0.01) & (gain("holdout") <= 0.01) & (gain("inner_oof") <= 0.01)
    return cells.filter("candidate <> 's1'").join(F.broadcast(old)).select("candidate", adopt.alias("adopt"))  # one row


RESULT_SQL = W + """, r AS (SELECT path, doc_id%7 AS k, CASE doc_id%13 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 1.5e0 ELSE (s2+3e0)/6e0 END AS score FROM ev),
s AS (SELECT *, CASE WHEN k=0 THEN 'error' WHEN k=1 THEN '' ELSE 'ok' END AS status FROM r)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN status NOT IN ('ok','error') THEN 'status' WHEN status='error' AND score IS NOT NULL THEN 'score with error' WHEN status='error' THEN 'error'
 WHEN score IS NULL THEN 'missing' WHEN isnan(score) OR isinf(score) THEN 'nonfinite' WHEN score<0 OR score>1 THEN 'range' ELSE 'valid' END AS problem FROM s) GROUP BY 1"""


@query("result_validation", RESULT_SQL)
def result_validation(spark, sf_dir):
    """Results are rejected, never clipped: status known, error without score, score there, finite, in 0 to 1."""
    k, m = F.col("doc_id") % 7, F.col("doc_id") % 13
    score = F.when(m == 0, F.lit(None).cast("double")).when(m == 1, F.lit(float("nan"))).when(m == 2, 1.5).otherwise((F.col("s2") + 3.0) / 6.0)
    status = F.when(k == 0, "error").when(k == 1, "").otherwise("ok")
    r = evaluation(spark, sf_dir).select(score.alias("score"), status.alias("status"))
    problem = (
        F.when(~F.col("status").isin("ok", "error"), "status").when((F.col("status") == "error") & F.col("score").isNotNull(), "score with error").when(F.col("status") == "error", "error")
        .when(F.col("score").isNull(), "missing").when(F.isnan("score") | (F.abs("score") == float("inf")), "nonfinite").when((F.col("score") < 0) | (F.col("score") > 1), "range").otherwise("valid")
    )
    return r.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


REFUSE_SQL = W + "SELECT 'in the wild' AS rule, count(*) FILTER (split='itw') AS n FROM ev WHERE fold<>'test' UNION ALL SELECT 'alias of a holdout row', count(*) FROM ev WHERE split='inner_oof' AND speaker IN (SELECT speaker FROM ev WHERE split='holdout' AND y=1)"


@query("manifest_refusals", REFUSE_SQL)
def manifest_refusals(spark, sf_dir):
    """Rows for which a training manifest is refused; both counts have to be zero."""
    ev = evaluation(spark, sf_dir)
    wild = ev.filter("fold <> 'test'").agg(F.count_if(F.col("split") == "itw").alias("n")).select(F.lit("in the wild").alias("rule"), "n")
    held = ev.filter("split = 'holdout' and y = 1").select("speaker").distinct()
    alias = ev.filter("split = 'inner_oof'").join(held, "speaker", "left_semi").agg(F.count("*").alias("n"))
    return wild.union(alias.select(F.lit("alias of a holdout row"), "n"))


LINE_SQL = WITH + "SELECT path, printf('0.6 x %.3f + 0.2 x %.3f + 0.2 x %.3f', r1, r2, r3) || CASE WHEN fused<base THEN '; suppressed' ELSE '' END || CASE WHEN y IS NULL THEN '; no label' ELSE '' END AS line FROM fused"


@query("fusion_line", LINE_SQL)
def fusion_line(spark, sf_dir):
    """How a fused score came about, in words."""
    d = fu.fused(evaluation(spark, sf_dir))
    clause = lambda c, text: F.when(c, text).otherwise("")
    terms = F.format_string("0.6 x %.3f + 0.2 x %.3f + 0.2 x %.3f", "r_s1", "r_s2", "r_s3")
    return d.select("path", F.concat(terms, clause(F.col("fused") < F.col("base"), "; suppressed"), clause(F.col("y").isNull(), "; no label")).alias("line"))


@query("per_model_cohort", W + f"SELECT generator, path FROM (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY {JIT.format(chr(39) + 'co:' + chr(39) + '||path')}, path) AS rn FROM ev WHERE y=1) WHERE rn<=5")
def per_model_cohort(spark, sf_dir):
    """Five positive rows of each generator, by a seeded draw."""
    ev = evaluation(spark, sf_dir).filter("y = 1").withColumn("draw", jitter(F.concat(F.lit("co:"), "path")))
    return capped(ev, ["generator"], ["draw", "path"], 5).select("generator", "path")


PATTERN = ["l_orderkey", "l_ship*", "l_linest*"]


@query("columns_by_pattern", "SELECT l_orderkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL")
def columns_by_pattern(spark, sf_dir):
    """Columns named exactly or by a prefix and a star; names that end like labels are left out."""
    t = table(spark, sf_dir, "lineitem")
    named = [c for c in t.columns if any(c == p or p.endswith("*") and c.startswith(p[:-1]) for p in PATTERN) and not c.endswith("status")]
    return t.select(*named).groupBy(*named).agg(F.count("*").alias("n"))
