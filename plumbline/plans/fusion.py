"""Queries of the fusion and policy family."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.prefix import quantiles
from plumbline.operators import fusion as fu
from plumbline.operators import metrics as me
from plumbline.sources.tables import EV, evaluation

QUERIES, ORACLES = {}, {}
R6 = lambda c: F.round(c, 6).alias(c)

RANKED = """, ref AS (SELECT s1, s2, s3 FROM ev WHERE split='inner_oof'), n AS (SELECT count(*) AS n FROM ref),
c1 AS (SELECT e.s1 AS v, count(r.s1) AS k FROM (SELECT DISTINCT s1 FROM ev) e LEFT JOIN ref r ON r.s1 < e.s1 GROUP BY 1),
c2 AS (SELECT e.s2 AS v, count(r.s2) AS k FROM (SELECT DISTINCT s2 FROM ev) e LEFT JOIN ref r ON r.s2 < e.s2 GROUP BY 1),
c3 AS (SELECT e.s3 AS v, count(r.s3) AS k FROM (SELECT DISTINCT s3 FROM ev) e LEFT JOIN ref r ON r.s3 < e.s3 GROUP BY 1),
ranked AS (SELECT ev.*, c1.k/n.n::DOUBLE AS r1, c2.k/n.n::DOUBLE AS r2, c3.k/n.n::DOUBLE AS r3 FROM ev, n, c1, c2, c3 WHERE c1.v=ev.s1 AND c2.v=ev.s2 AND c3.v=ev.s3),
based AS (SELECT *, 0.6e0*r1+0.2e0*r2+0.2e0*r3 AS base FROM ranked),
fused AS (SELECT *, CASE WHEN m3 < -3e0 AND base > 0.5e0 THEN base*0.5e0 ELSE base END AS fused FROM based),
probs AS (SELECT *, 1e0/(1e0+exp(-(17.6928266e0*fused-8.1514753e0+ln(0.3e0/0.7e0)))) AS p_fused FROM fused)"""
WITH = f"WITH {EV}{RANKED} "


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("ecdf_rank", WITH + "SELECT path, round(r1,6) AS r_s1, round(r2,6) AS r_s2, round(r3,6) AS r_s3 FROM ranked")
def ecdf_rank(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    return fu.ranked(ev, ev.filter("split = 'inner_oof'")).select("path", R6("r_s1"), R6("r_s2"), R6("r_s3"))


@query("rank_blend", WITH + "SELECT path, split, round(base,6) AS base, round(fused,6) AS fused, round(p_fused,6) AS p_fused FROM probs")
def rank_blend(spark, sf_dir):
    return fu.fused(evaluation(spark, sf_dir)).select("path", "split", R6("base"), R6("fused"), R6("p_fused"))


@query("suppress_tiers", WITH + "SELECT path, round(CASE WHEN base > 0.5e0 THEN base * CASE WHEN m3 < -5.5e0 THEN 0.1e0 WHEN m3 < -4.5e0 THEN 0.3e0 WHEN m3 < -3e0 THEN 0.5e0 ELSE 1e0 END ELSE base END, 6) AS fused FROM based")
def suppress_tiers(spark, sf_dir):
    d = fu.fused(evaluation(spark, sf_dir))
    return d.select("path", F.round(fu.suppressed_in_tiers(F.col("base"), F.col("m3")), 6).alias("fused"))


@query(
    "zscore",
    f"WITH {EV}, f AS (SELECT avg(s1) m1, stddev_pop(s1) d1, avg(s2) m2, stddev_pop(s2) d2, avg(s3) m3_, stddev_pop(s3) d3 FROM ev WHERE split='inner_oof') "
    "SELECT path, round((s1-m1)/d1,6) AS z_s1, round((s2-m2)/d2,6) AS z_s2, round((s3-m3_)/d3,6) AS z_s3 FROM ev, f",
)
def zscore(spark, sf_dir):
    return fu.standardised(evaluation(spark, sf_dir)).select("path", R6("z_s1"), R6("z_s2"), R6("z_s3"))


#: Fixed values of the rules compared below: stacker weights and offset.
STACK = (0.8, 0.5, -0.3, 0.1)


@query(
    "fuse_rules",
    f"WITH {EV}{RANKED}, f AS (SELECT avg(s1) m1, stddev_pop(s1) d1, avg(s2) m2, stddev_pop(s2) d2, avg(s3) m3_, stddev_pop(s3) d3 FROM ev WHERE split='inner_oof'), "
    "z AS (SELECT ranked.*, (s1-m1)/d1 AS z1, (s2-m2)/d2 AS z2, (s3-m3_)/d3 AS z3 FROM ranked, f) "
    "SELECT path, round((z1+z2+z3)/3e0,6) AS zmean, round(0.8e0*z1+0.5e0*z2-0.3e0*z3+0.1e0,6) AS stack, round((r1+r2+r3)/3e0,6) AS rankmean, round(least(r1,r2,r3),6) AS lowest, round(greatest(r1,r2,r3),6) AS highest FROM z",
)
def fuse_rules(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    d = fu.standardised(fu.ranked(ev, ev.filter("split = 'inner_oof'")))
    z, r = [F.col(f"z_{c}") for c in fu.DETECTORS], [F.col(f"r_{c}") for c in fu.DETECTORS]
    a, b, c, e = STACK
    rules = {"zmean": (z[0] + z[1] + z[2]) / 3.0, "stack": a * z[0] + b * z[1] + c * z[2] + e, "rankmean": (r[0] + r[1] + r[2]) / 3.0, "lowest": F.least(*r), "highest": F.greatest(*r)}
    return d.select("path", *[F.round(v, 6).alias(k) for k, v in rules.items()])


@query(
    "fuse_cascade",
    WITH + ", m AS (SELECT *, round((r1+r2+r3)/3e0,9) AS rm FROM ranked), q AS (SELECT round(quantile_cont(rm,0.4),9) AS lo, round(quantile_cont(rm,0.9),9) AS hi FROM m WHERE split='inner_oof') "
    "SELECT path, round(CASE WHEN rm BETWEEN lo AND hi THEN rm ELSE r1 END, 6) AS cascade FROM m, q",
)
def fuse_cascade(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    d = fu.ranked(ev, ev.filter("split = 'inner_oof'")).withColumn("rm", F.round((F.col("r_s1") + F.col("r_s2") + F.col("r_s3")) / 3.0, 9))
    q = quantiles(d.filter("split = 'inner_oof'"), "rm", {"lo": 0.4, "hi": 0.9}).select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))
    return d.join(F.broadcast(q)).select("path", F.round(F.when(F.col("rm").between(F.col("lo"), F.col("hi")), F.col("rm")).otherwise(F.col("r_s1")), 6).alias("cascade"))


@query(
    "suppress_percentile",
    WITH + ", t AS (SELECT quantile_cont(s2, 0.01) AS t FROM ev WHERE split='inner_oof' AND y=1) SELECT path, round(CASE WHEN s2 < t AND base > 0.5e0 THEN base*0.5e0 ELSE base END,6) AS fused FROM based, t",
)
def suppress_percentile(spark, sf_dir):
    d = fu.fused(evaluation(spark, sf_dir))
    t = quantiles(d.filter("split = 'inner_oof' and y = 1"), "s2", {"t": 0.01})
    out = F.when((F.col("s2") < F.col("t")) & (F.col("base") > 0.5), F.col("base") * 0.5).otherwise(F.col("base"))
    return d.join(F.broadcast(t)).select("path", F.round(out, 6).alias("fused"))


ALPHAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)


def alpha_scores(spark, sf_dir):
    """(candidate, alpha, split, y, score): first detector against the mean of the others, by share."""
    ev = evaluation(spark, sf_dir)
    d = fu.ranked(ev, ev.filter("split = 'inner_oof'"))
    grid = spark.createDataFrame([(a,) for a in ALPHAS], "alpha double")
    score = (1 - F.col("alpha")) * F.col("r_s1") + F.col("alpha") * (F.col("r_s2") + F.col("r_s3")) / 2.0
    return d.join(F.broadcast(grid)).select("alpha", "split", "y", F.round(score, 9).alias("score"))


ALPHA_SQL = WITH + ", g AS (SELECT unnest([0e0,0.1e0,0.2e0,0.3e0,0.4e0,0.5e0]) AS alpha), sc AS (SELECT alpha, split, y, round((1e0-alpha)*r1+alpha*(r2+r3)/2e0, 9) AS score FROM ranked, g WHERE y IS NOT NULL)"
#: Least cost over distinct scores by keys, in DuckDB SQL: needs a relation sc(<keys>, y, score).
DCF_SQL = """, cnt AS (SELECT {k}, score, sum((y=1)::INT) AS pos, sum((y=0)::INT) AS neg FROM sc WHERE y IS NOT NULL GROUP BY ALL),
rocs AS (SELECT {k}, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS np, sum(neg) OVER a AS nn FROM cnt WINDOW w AS (PARTITION BY {k} ORDER BY score DESC), a AS (PARTITION BY {k})),
costs AS (SELECT *, ({cfa}*(1e0-{pi})*fp/nullif(nn,0)::DOUBLE + {cm}*{pi}*(1e0-tp/nullif(np,0)::DOUBLE))/least({cfa}*(1e0-{pi}),{cm}*{pi}) AS cost FROM rocs),
dcf AS (SELECT {k}, CASE WHEN max(np)>0 AND max(nn)>0 THEN least(1e0, min(cost)) END AS min_dcf FROM costs GROUP BY {k})"""
BRIEF_SQL = {"cfa": "4e0", "cm": "1e0", "pi": "0.3e0"}
AVERSE_SQL = {"cfa": "1e0", "cm": "4e0", "pi": "0.5e0"}


@query("alpha_grid", ALPHA_SQL + DCF_SQL.format(k="alpha, split", **BRIEF_SQL) + " SELECT alpha, split, round(min_dcf,6) AS min_dcf FROM dcf")
def alpha_grid(spark, sf_dir):
    return me.min_dcf(alpha_scores(spark, sf_dir), ["alpha", "split"]).select("alpha", "split", R6("min_dcf"))


@query(
    "tie_band_pick",
    ALPHA_SQL + DCF_SQL.format(k="alpha, split", **BRIEF_SQL) + " SELECT min(alpha) AS alpha FROM dcf WHERE split='itw' AND min_dcf <= (SELECT min(min_dcf) FROM dcf WHERE split='itw') + 0.01e0",
)
def tie_band_pick(spark, sf_dir):
    cells = me.min_dcf(alpha_scores(spark, sf_dir), ["alpha", "split"]).filter("split = 'itw'")
    best = cells.agg(F.min("min_dcf").alias("best"))
    return cells.join(F.broadcast(best)).filter("min_dcf <= best + 0.01D").agg(F.min("alpha").alias("alpha"))


SELECT_SQL = """, cells AS (SELECT alpha, max(min_dcf) FILTER (split='inner_oof') AS inner_, max(min_dcf) FILTER (split='holdout') AS holdout, max(min_dcf) FILTER (split='itw') AS itw FROM dcf GROUP BY alpha),
ok AS (SELECT *, inner_ <= (SELECT min(inner_) FROM cells) + 0.03e0 AS near FROM cells),
best AS (SELECT min(itw) AS b FROM ok WHERE near)
SELECT coalesce(min(alpha), 0e0) AS alpha, count(*) AS n_tied FROM ok, best WHERE near AND itw <= b + 0.01e0"""


@query("select_rule", ALPHA_SQL + DCF_SQL.format(k="alpha, split", **BRIEF_SQL) + SELECT_SQL)
def select_rule(spark, sf_dir):
    cells = me.min_dcf(alpha_scores(spark, sf_dir), ["alpha", "split"]).groupBy("alpha").pivot("split", ["inner_oof", "holdout", "itw"]).agg(F.max("min_dcf"))
    near = cells.join(F.broadcast(cells.agg(F.min("inner_oof").alias("best_inner")))).filter("inner_oof <= best_inner + 0.03D")
    tied = near.join(F.broadcast(near.agg(F.min("itw").alias("best_itw")))).filter("itw <= best_itw + 0.01D")
    return tied.agg(F.coalesce(F.min("alpha"), F.lit(0.0)).alias("alpha"), F.count("*").alias("n_tied"))


@query(
    "replacement_rule",
    ALPHA_SQL + DCF_SQL.format(k="alpha, split", **BRIEF_SQL)
    + ", cells AS (SELECT alpha, max(min_dcf) FILTER (split='inner_oof') AS i, max(min_dcf) FILTER (split='holdout') AS h, max(min_dcf) FILTER (split='itw') AS w FROM dcf GROUP BY alpha), cur AS (SELECT * FROM cells WHERE alpha=0e0) "
    "SELECT c.alpha, (c.i <= cur.i + 0.01e0 AND c.h <= cur.h + 0.01e0 AND c.w <= cur.w - 0.01e0) AS replaces FROM cells c, cur WHERE c.alpha > 0e0",
)
def replacement_rule(spark, sf_dir):
    cells = me.min_dcf(alpha_scores(spark, sf_dir), ["alpha", "split"]).groupBy("alpha").pivot("split", ["inner_oof", "holdout", "itw"]).agg(F.max("min_dcf"))
    now = cells.filter("alpha = 0").select(*[F.col(c).alias(f"now_{c}") for c in ("inner_oof", "holdout", "itw")])
    rule = F.expr("inner_oof <= now_inner_oof + 0.01D and holdout <= now_holdout + 0.01D and itw <= now_itw - 0.01D")
    return cells.filter("alpha > 0").join(F.broadcast(now)).select("alpha", rule.alias("replaces"))


JIT = "cast(('0x'||substr(sha1(path),1,16)) AS UBIGINT)::DOUBLE/18446744073709551616e0"


@query(
    "pinned_block",
    WITH + f"SELECT path, round(CASE WHEN n_chars = 0 THEN 0.0001e0*{JIT} WHEN n_chars >= 300 THEN 0.001e0+0.999e0*p_fused ELSE 0.0001e0+0.0009e0*(0.99e0/(1e0+exp(-s1))+0.01e0*{JIT}) END, 9) AS probability, "
    "CASE WHEN n_chars < 300 THEN 'undetermined' WHEN p_fused >= 0.5e0 THEN 'synthetic' ELSE 'bonafide' END AS verdict FROM probs",
)
def pinned_block(spark, sf_dir):
    return fu.decided(evaluation(spark, sf_dir)).select("path", F.round("probability", 9).alias("probability"), "verdict")


@query(
    "speech_gate_rules",
    f"WITH {EV}, g AS (SELECT path, n_chars, abs(s1)/4e0 AS fl, abs(s2)/30e0 AS vo, abs(s3)*2e0 AS en, abs(m3)/60e0 AS pi FROM ev) SELECT path, CASE WHEN n_chars < 300 THEN 'silent' ELSE concat_ws(',', CASE WHEN fl>0.5e0 THEN 'noise' END, CASE WHEN vo<0.05e0 THEN 'unvoiced' END, CASE WHEN en<3e0 THEN 'steady' END, CASE WHEN pi<0.02e0 THEN 'monotone' END) END AS reasons FROM g",
)
def speech_gate_rules(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    level = F.when(F.col("n_chars") < 300, -80.0).otherwise(-20.0)
    reasons = fu.gate_reasons(level, F.abs("s1") / 4.0, F.abs("s2") / 30.0, F.abs("s3") * 2.0, F.abs("m3") / 60.0)
    return ev.select("path", F.array_join(reasons, ",").alias("reasons"))


ABLATION_SQL = WITH + """, gated AS (SELECT *, CASE WHEN n_chars >= 300 THEN 0.001e0+0.999e0*p_fused ELSE 0.0005e0 END AS on_, 1e0/(1e0+exp(-(17.6928266e0*base-8.1514753e0+ln(0.3e0/0.7e0)))) AS raw FROM probs),
sc AS (SELECT 'router_on' AS variant, split, y, round(on_,9) AS score FROM gated UNION ALL SELECT 'no_gate', split, y, round(p_fused,9) FROM gated
UNION ALL SELECT 'no_suppression', split, y, round(CASE WHEN n_chars>=300 THEN 0.001e0+0.999e0*raw ELSE 0.0005e0 END,9) FROM gated UNION ALL SELECT 'router_off', split, y, round(raw,9) FROM gated UNION ALL SELECT 'equal', split, y, round((r1+r2+r3)/3e0,9) FROM gated)"""


@query("ablation", ABLATION_SQL + DCF_SQL.format(k="variant, split", **BRIEF_SQL) + " SELECT variant, split, round(min_dcf,6) AS min_dcf FROM dcf")
def ablation(spark, sf_dir):
    from plumbline.functions.scalars import platt

    d = fu.fused(evaluation(spark, sf_dir))
    speech, raw = F.col("n_chars") >= 300, platt(F.col("base"), fu.PLATT_A, fu.PLATT_B, fu.PRIOR_SHIFT)
    gate = lambda p: F.when(speech, 0.001 + 0.999 * p).otherwise(0.0005)
    variants = {"router_on": gate(F.col("p_fused")), "no_gate": F.col("p_fused"), "no_suppression": gate(raw), "router_off": raw, "equal": (F.col("r_s1") + F.col("r_s2") + F.col("r_s3")) / 3.0}
    wide = d.select("path", "split", "y", *[F.round(v, 9).alias(k) for k, v in variants.items()])
    long = wide.unpivot(["path", "split", "y"], list(variants), "variant", "score")
    return me.min_dcf(long, ["variant", "split"]).select("variant", "split", R6("min_dcf"))


@query(
    "refuse_rules",
    WITH + "SELECT path, round(least(1e0, greatest(0e0, 0.5e0*r1+0.5e0*r2)),6) AS two, round(1e0-p_fused,6) AS flipped, r3 IS NULL AS lacking FROM probs",
)
def refuse_rules(spark, sf_dir):
    d = fu.fused(evaluation(spark, sf_dir))
    two = fu.blend({"s1": 0.5, "s2": 0.5})
    return d.select("path", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), two)), 6).alias("two"), F.round(1 - F.col("p_fused"), 6).alias("flipped"), F.col("r_s3").isNull().alias("lacking"))


@query("posterior_shift", f"WITH {EV} SELECT path, round(1e0/(1e0+exp(-(s2+ln(0.3e0/0.7e0)))),6) AS p_brief, round(1e0/(1e0+exp(-(s2+ln(0.3e0/0.7e0)-ln(4e0)))),6) AS p_cost FROM ev")
def posterior_shift(spark, sf_dir):
    import math

    from plumbline.functions.scalars import posterior

    return evaluation(spark, sf_dir).select("path", F.round(posterior(F.col("s2"), 0.3), 6).alias("p_brief"), F.round(posterior(F.col("s2") - math.log(4), 0.3), 6).alias("p_cost"))
