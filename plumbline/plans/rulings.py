"""Queries of rulings on candidates and documents: bake-off, identifiability, scans, twins, checks and stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.functions.prefix import quantiles
from plumbline.functions.scalars import AVERSE, BRIEF
from plumbline.operators import expect, ranks, sensitivity
from plumbline.operators import metrics as me
from plumbline.operators import rulings as ru
from plumbline.plans.fusion import BRIEF_SQL, DCF_SQL
from plumbline.plans.models import clips
from plumbline.plans.studies import _cramer
from plumbline.sources.tables import EV, evaluation, long_scores, table

QUERIES, ORACLES = {}, {}
W = f"WITH {EV}, "
R6 = lambda c: F.round(c, 6).alias(c)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# bake-off

#: Kinds of change to a score, the cells they make with two costs, the loss that is let pass, the drift that voids a run. Fixed values.
KINDS = ("none", "noise", "shift", "scale", "fold")
LOSS, EPS, DRIFT = 0.01, 1e-12, 1e-9
CHANGED = {"none": "{s}", "noise": "{s}+m3/8e0", "shift": "{s}+0.5e0", "scale": "{s}*0.8e0", "fold": "{s}-(doc_id%3)/4e0"}
CELLS_SQL = "cells AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{c}' AS candidate, y, round({x.format(s=c)},9) AS score FROM ev WHERE split='holdout' AND y IS NOT NULL" for k, x in CHANGED.items() for c in ("s1", "s2", "s3")) + ")"
BOTH_SQL = ", pair AS (SELECT {k}, CASE WHEN max(np)>0 AND max(nn)>0 THEN least(1e0, min((0.5e0*fp/nullif(nn,0)::DOUBLE+2e0*(1e0-tp/nullif(np,0)::DOUBLE))/0.5e0)) END AS averse FROM rocs GROUP BY {k})"
BAKE_SQL = f"""WITH {EV}, {CELLS_SQL}, p AS (WITH sc AS (SELECT * FROM cells){DCF_SQL.format(k="kind, candidate", **BRIEF_SQL)}{BOTH_SQL.format(k="kind, candidate")} SELECT kind, candidate, min_dcf AS brief, averse FROM dcf JOIN pair USING (kind, candidate)),
s AS (WITH sc AS (SELECT candidate, split, y, round(score,9) AS score FROM scores WHERE y IS NOT NULL){DCF_SQL.format(k="candidate, split", **BRIEF_SQL)} SELECT candidate, max(min_dcf) FILTER (split='inner_oof') AS i, max(min_dcf) FILTER (split='holdout') AS h, max(min_dcf) FILTER (split='itw') AS w FROM dcf GROUP BY 1),
d AS (SELECT n.candidate, count(o.brief-n.brief)+count(o.averse-n.averse) AS n_cells, min(least(o.brief-n.brief, o.averse-n.averse)) AS worst FROM p n JOIN p o USING (kind) WHERE o.candidate='s1' AND n.candidate<>'s1' GROUP BY 1),
t AS (SELECT c.candidate, max(abs(c.score-round(v.score,9))) AS drift FROM (SELECT candidate, score, row_number() OVER (PARTITION BY candidate ORDER BY score, y) AS k FROM cells WHERE kind='none') c JOIN (SELECT candidate, round(score,9) AS score, row_number() OVER (PARTITION BY candidate ORDER BY round(score,9), y) AS k FROM scores WHERE split='holdout' AND y IS NOT NULL) v USING (candidate, k) GROUP BY 1)
SELECT d.candidate, coalesce(n.i <= o.i+0.01e0 AND n.h <= o.h+0.01e0 AND n.w <= o.w-0.01e0, false) AS standing, n_cells::INT AS n_cells, round(worst,6) AS worst, round(drift,9) AS drift,
 CASE WHEN n_cells<>10 OR NOT drift <= 1e-9 THEN 'INVALID' WHEN coalesce(n.i <= o.i+0.01e0 AND n.h <= o.h+0.01e0 AND n.w <= o.w-0.01e0, false) AND worst >= -0.01e0-1e-12 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM d JOIN t USING (candidate) JOIN s n USING (candidate), s o WHERE o.candidate='s1'"""


def _changed(ev):
    """(path, y, candidate, kind, score) of the holdout under every kind of change."""
    third = (F.col("doc_id") % 3) / 4.0
    to = {"none": lambda s: s, "noise": lambda s: s + F.col("m3") / 8.0, "shift": lambda s: s + 0.5, "scale": lambda s: s * 0.8, "fold": lambda s: s - third}
    made = [F.struct(F.lit(c).alias("candidate"), F.lit(k).alias("kind"), F.round(to[k](F.col(c)), 9).alias("score")) for c in ("s1", "s2", "s3") for k in KINDS]
    held = ev.filter("split = 'holdout' and y is not null")
    return held.select("path", "y", F.explode(F.array(*made)).alias("m")).select("path", "y", "m.*")


@query("bakeoff", BAKE_SQL)
def bakeoff(spark, sf_dir):
    """Whether a candidate replaces the first detector: the standing rule, and no loss over ten cells of changed scores.

    A run is void unless all ten cells (five kinds, two costs) are there and the unchanged kind repeats the stored scores.
    """
    ev = evaluation(spark, sf_dir)
    cells = settled(_changed(ev))
    cost = lambda name, c: me.min_dcf(cells, ["kind", "candidate"], c).withColumnRenamed("min_dcf", name)
    p = settled(cost("brief", BRIEF).join(cost("averse", AVERSE), ["kind", "candidate"]))  # fifteen rows
    old = p.filter("candidate = 's1'").select("kind", F.col("brief").alias("ob"), F.col("averse").alias("oa"))
    gain = [F.col("ob") - F.col("brief"), F.col("oa") - F.col("averse")]
    d = p.filter("candidate <> 's1'").join(F.broadcast(old), "kind").groupBy("candidate").agg((F.count(gain[0]) + F.count(gain[1])).cast("int").alias("n_cells"), F.min(F.least(*gain)).alias("worst"))
    stored = long_scores(ev).filter("split = 'holdout' and y is not null").select("path", "candidate", F.round("score", 9).alias("stored"))
    t = cells.filter("kind = 'none'").join(stored, ["path", "candidate"]).groupBy("candidate").agg(F.max(F.abs(F.col("score") - F.col("stored"))).alias("drift"))
    rows = long_scores(ev).filter("y is not null").withColumn("score", F.round("score", 9))
    s = me.min_dcf(rows, ["candidate", "split"]).groupBy("candidate").pivot("split", ["inner_oof", "holdout", "itw"]).agg(F.max("min_dcf"))
    s = settled(s)
    now = s.filter("candidate = 's1'").select(*[F.col(c).alias(f"now_{c}") for c in ("inner_oof", "holdout", "itw")])
    standing = F.coalesce(F.expr("inner_oof <= now_inner_oof + 0.01D and holdout <= now_holdout + 0.01D and itw <= now_itw - 0.01D"), F.lit(False))
    both = d.join(t, "candidate").join(s, "candidate").join(F.broadcast(now)).withColumn("standing", standing)  # one row
    void = (F.col("n_cells") != 2 * len(KINDS)) | F.coalesce(F.col("drift") > DRIFT, F.lit(True))
    passed = F.col("standing") & (F.col("worst") >= -LOSS - EPS)
    verdict = F.when(void, "INVALID").when(passed, "PASS").otherwise("FAIL")
    return both.select("candidate", "standing", "n_cells", R6("worst"), F.round("drift", 9).alias("drift"), verdict.alias("verdict"))


@query("bakeoff_bootstrap")
def bakeoff_bootstrap(spark, sf_dir, draws: int = 200):
    """Fifth percentile of what a candidate gains over the first detector in the wild, over draws of whole speakers, for two costs."""
    wild = evaluation(spark, sf_dir).filter("split = 'itw' and y is not null")
    by = {c: ranks.min_dcf_draws(wild, "speaker", c, draws, {"brief": BRIEF, "averse": AVERSE}, 5) for c in ("s1", "s2", "s3")}
    made = None
    for c in ("s2", "s3"):
        both = by[c].alias("n").join(by["s1"].alias("o"), "draw")
        gains = settled(both.select(*[(F.col(f"o.{k}") - F.col(f"n.{k}")).alias(k) for k in ("brief", "averse")]))
        p5 = [quantiles(gains, k, {f"{k}_p5": 0.05}) for k in ("brief", "averse")]
        n = gains.agg(F.count("brief").alias("n_draws"))
        one = p5[0].join(F.broadcast(p5[1])).join(F.broadcast(n))  # one row each
        row = one.select(F.lit(c).alias("candidate"), R6("brief_p5"), R6("averse_p5"), "n_draws", F.coalesce(F.expr("brief_p5 > 0 and averse_p5 > 0"), F.lit(False)).alias("gains"))
        made = row if made is None else made.unionByName(row)
    return made


# identifiability

GUARD_SQL = W + "u AS (SELECT *, (score>0e0)::INT AS hit FROM scores), sc AS (SELECT candidate, (generator='en')::INT AS y, round(score,9) AS score FROM scores WHERE generator IN ('en','de') AND split<>'test')" + DCF_SQL.format(k="candidate", **BRIEF_SQL) + """, a AS (SELECT candidate, sum(pos*(nn-fp+neg/2e0))/nullif(max(np)*max(nn),0) AS auc FROM rocs GROUP BY 1),
r AS (SELECT candidate, avg(hit) FILTER (generator='fr' AND split<>'test') AS clean, avg(hit) FILTER (generator='es' AND source='src7' AND split<>'test') AS spoof, avg(hit) FILTER (split='test') AS q,
 avg(hit) FILTER (generator='en' AND split<>'test') AS t, avg(hit) FILTER (generator='de' AND split<>'test') AS f, avg(hit) FILTER (generator='de' AND split<>'test' AND source<>'src0') AS f2 FROM u GROUP BY 1),
l AS (SELECT candidate, auc, clean, spoof, CASE WHEN t-f >= 0.001e0 THEN greatest(0e0, least(1e0, (q-f)/(t-f))) END AS lam, CASE WHEN t-f2 >= 0.001e0 THEN greatest(0e0, least(1e0, (q-f2)/(t-f2))) END AS lam2 FROM a JOIN r USING (candidate))
SELECT candidate, round(auc,6) AS auc, round(clean,6) AS clean, round(spoof,6) AS spoof, round(lam,6) AS share, round(lam2,6) AS share_without, concat_ws(', ', CASE WHEN auc >= 0.8e0 THEN NULL ELSE 'auc' END, CASE WHEN clean < 0.25e0 THEN NULL ELSE 'clean control' END, CASE WHEN spoof < 0.25e0 THEN NULL ELSE 'spoof control' END, CASE WHEN abs(lam-lam2) <= 0.15e0 THEN NULL ELSE 'one source' END) AS failed FROM l"""


@query("identifiable", GUARD_SQL)
def identifiable(spark, sf_dir):
    """Whether a domain share may be told at all: four guards, and a missing figure fails its guard.

    The domains are apart, an unseen clean control reads clean, a control of spoofs does not read wild, and the share
    hardly moves without one source.
    """
    rows = settled(long_scores(evaluation(spark, sf_dir)).withColumn("hit", (F.col("score") > 0).cast("int")))
    known = F.col("split") != "test"
    auc = me.auc(rows.filter(known & F.col("generator").isin("en", "de")).select("candidate", (F.col("generator") == "en").cast("int").alias("y"), F.round("score", 9).alias("score")), ["candidate"])
    rate = lambda c, name: F.avg(F.when(c, F.col("hit"))).alias(name)
    of = lambda g: known & (F.col("generator") == g)
    r = rows.groupBy("candidate").agg(
        rate(of("fr"), "clean"), rate(of("es") & (F.col("source") == "src7"), "spoof"), rate(~known, "q"), rate(of("en"), "t"),
        rate(of("de"), "f"), rate(of("de") & (F.col("source") != "src0"), "f2"),
    )
    share = lambda f: F.when(F.col("t") - F.col(f) >= 0.001, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("q") - F.col(f)) / (F.col("t") - F.col(f)))))
    d = auc.join(r, "candidate").withColumns({"share": share("f"), "share_without": share("f2")})
    guards = {"auc": F.col("auc") >= 0.8, "clean control": F.col("clean") < 0.25, "spoof control": F.col("spoof") < 0.25, "one source": F.abs(F.col("share") - F.col("share_without")) <= 0.15}
    failed = F.concat_ws(", ", *[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in guards.items()])
    return d.select("candidate", *[R6(c) for c in ("auc", "clean", "spoof", "share", "share_without")], failed.alias("failed"))


# scans and twins

SCAN_SQL = "WITH sc AS (SELECT dim, (label=0)::INT AS y, v AS score FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0,len(embedding)))::INT AS dim FROM embeddings))" + DCF_SQL.format(k="dim", **BRIEF_SQL) + ", a AS (SELECT dim, sum(pos*(nn-fp+neg/2e0))/(max(np)*max(nn)) AS auc FROM rocs GROUP BY 1) SELECT dim, round(auc,6) AS auc, round(greatest(auc,1e0-auc),6) AS strength, auc>=0.5e0 AS up FROM a"


@query("auc_scan", SCAN_SQL)
def auc_scan(spark, sf_dir):
    """How well each element of a vector tells one label from the rest, all elements in one pass, whichever way it points."""
    e = table(spark, sf_dir, "embeddings").select((F.col("label") == 0).cast("int").alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "score"))
    auc = me.auc(e, ["dim"])
    return auc.select("dim", R6("auc"), F.round(F.greatest(F.col("auc"), 1 - F.col("auc")), 6).alias("strength"), (F.col("auc") >= 0.5).alias("up"))


def _twin_mse_sql() -> str:
    """Out-of-fold error on clean rows of a fit on s2 and s3 that has seen the twins of the other folds."""
    x = ["1e0", "s2", "s3", "y"]
    cells = {f"s{i}{j}": f"sum({a}*{b})" for i, a in enumerate(x) for j, b in enumerate(x) if i <= j}
    of = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    fit = _cramer([[of(i, j) for j in range(3)] for i in range(3)], [of(i, 3) for i in range(3)])
    error = "s33" + "".join(f"-2e0*b{i}*{of(i, 3)}" for i in range(3)) + "".join(f"+b{i}*b{j}*{of(i, j)}" for i in range(3) for j in range(3))
    sums = ", ".join(f"{v} AS {c}" for c, v in cells.items())
    return f"""f AS (SELECT fold, {sums} FROM d GROUP BY fold), r AS (SELECT fold, {sums} FROM d WHERE clean GROUP BY fold), a AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in cells)} FROM f),
b AS (SELECT fold, {", ".join(f"{v} AS b{i}" for i, v in enumerate(fit))} FROM (SELECT f.fold, {", ".join(f"a.{c}-f.{c} AS {c}" for c in cells)} FROM f, a))
SELECT (SELECT count(*) FROM d) AS n_fit, (SELECT count(*) FROM d WHERE clean) AS n_readout, (SELECT round(sum({error})/sum(s00),6) FROM r JOIN b USING (fold)) AS mse"""


TWIN_SQL = W + "d AS (SELECT fold, s2, s3, y::DOUBLE AS y, true AS clean FROM ev WHERE split='inner_oof' UNION ALL SELECT fold, s2+0.3e0, s3*0.9e0, y::DOUBLE, false FROM ev WHERE split='inner_oof' AND y=1), " + _twin_mse_sql()


@query("fit_only_twins", TWIN_SQL)
def fit_only_twins(spark, sf_dir):
    """An augmented twin takes the fold of its clean row, is fitted on with it, and is never read out."""
    clean = evaluation(spark, sf_dir).filter("split = 'inner_oof'").select("fold", "s2", "s3", "y", F.lit(False).alias("twin"))
    twins = clean.filter("y = 1").select("fold", (F.col("s2") + 0.3).alias("s2"), (F.col("s3") * 0.9).alias("s3"), "y", F.lit(True).alias("twin"))
    rows = settled(clean.unionByName(twins))
    made = sensitivity.least_squares_study(rows, ["s2", "s3"], "y", "fold", {"all": []}, fit_only="twin")
    fitted = rows.agg(F.count("*").alias("n_fit"))
    return made.join(F.broadcast(fitted)).select("n_fit", F.col("n").alias("n_readout"), R6("mse"))  # one row


# documents of constants

DOC_SQL = """CASE WHEN doc_id%29=0 THEN '{"weights": ' WHEN doc_id%31=0 THEN '[1]' ELSE '{'||CASE WHEN doc_id%5=0 OR doc_id%17=0 THEN '"alpha":'||CASE WHEN doc_id%25=0 THEN 'true' ELSE ((doc_id%15)//10)||'.'||((doc_id%15)%10) END||',' ELSE '' END||CASE WHEN doc_id%5<>0 OR doc_id%17=0 THEN '"weights":{"s1":0.'||lpad((doc_id%90+5)::VARCHAR,2,'0')||',"'||CASE WHEN doc_id%19=0 THEN 'other' ELSE 's2' END||'":0.'||CASE WHEN doc_id%23=0 THEN '99' ELSE lpad((95-doc_id%90)::VARCHAR,2,'0') END||'},' ELSE '' END
 ||'"references":{"s1":[0,'||n_chars||'],"s2":[-1,'||(doc_id%7-3)||',9],"other":[]},"platt":{"a":'||CASE WHEN doc_id%11=0 THEN '"1"' ELSE '1.5' END||',"b":-2,"prior_shift":0},"suppression":{"applied":'||CASE WHEN doc_id%3=0 THEN 'true' ELSE 'false' END||',"logit_below":-3,"rank_above":'||CASE WHEN doc_id%13=0 THEN 'null' ELSE '0.5' END||',"multiply_by":0.5}}' END"""
_NUM = "coalesce(json_type(d,'{p}') IN ('UBIGINT','BIGINT','DOUBLE'), false)"
_HAVE = "coalesce(json_type(d,'{p}'), 'NULL') <> 'NULL'"
_RULE_SQL = f"""CASE WHEN NOT json_valid(d) THEN 'not json' WHEN json_type(d) <> 'OBJECT' THEN 'not an object' WHEN ({_HAVE.format(p="$.alpha")}) = ({_HAVE.format(p="$.weights")}) THEN 'alpha or weights'
 WHEN {_HAVE.format(p="$.alpha")} AND NOT ({_NUM.format(p="$.alpha")} AND try_cast(d->>'$.alpha' AS DOUBLE) BETWEEN 0 AND 1) THEN 'alpha'
 WHEN {_HAVE.format(p="$.weights")} AND NOT abs(list_sum(list_transform(json_keys(d,'$.weights'), lambda k: (d->'$.weights'->>k)::DOUBLE))-1e0) <= 1e-9 THEN 'weights'
 WHEN list_has(json_keys(d,'$.weights'), 'other') THEN 'unknown name'
 WHEN NOT ((d->>'$.references.s1[0]')::DOUBLE <= (d->>'$.references.s1[1]')::DOUBLE AND (d->>'$.references.s2[0]')::DOUBLE <= (d->>'$.references.s2[1]')::DOUBLE AND (d->>'$.references.s2[1]')::DOUBLE <= (d->>'$.references.s2[2]')::DOUBLE) THEN 'reference'
 WHEN NOT ({_NUM.format(p="$.platt.a")} AND {_NUM.format(p="$.platt.b")} AND {_NUM.format(p="$.platt.prior_shift")}) THEN 'platt'
 WHEN (d->>'$.suppression.applied')='true' AND NOT ({_NUM.format(p="$.suppression.logit_below")} AND {_NUM.format(p="$.suppression.rank_above")} AND {_NUM.format(p="$.suppression.multiply_by")}) THEN 'suppression' ELSE '' END"""


CONSTANTS_SQL = f"WITH c AS (SELECT doc_id, {DOC_SQL} AS t FROM documents WHERE n_chars IS NOT NULL), g AS (SELECT doc_id, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN t ELSE '{{}}' END AS d FROM c) SELECT doc_id, CASE WHEN NOT ok THEN 'not json' ELSE {_RULE_SQL} END AS problem FROM g"


@query("constants_validation", CONSTANTS_SQL)
def constants_validation(spark, sf_dir):
    """Documents of fusion constants made of each row's numbers, with faults, and the first thing that is wrong with each."""
    n = F.col("doc_id")
    text = lambda c: c.cast("string")
    two = lambda c: F.lpad(text(c), 2, "0")
    alpha = F.when(n % 25 == 0, "true").otherwise(F.concat(text(F.floor((n % 15) / 10)), F.lit("."), text((n % 15) % 10)))
    weights = F.concat(F.lit('"weights":{"s1":0.'), two(n % 90 + 5), F.lit(',"'), F.when(n % 19 == 0, "other").otherwise("s2"), F.lit('":0.'), F.when(n % 23 == 0, "99").otherwise(two(95 - n % 90)), F.lit("},"))
    rest = F.concat(
        F.lit('"references":{"s1":[0,'), text(F.col("n_chars")), F.lit('],"s2":[-1,'), text(n % 7 - 3), F.lit(',9],"other":[]},"platt":{"a":'), F.when(n % 11 == 0, '"1"').otherwise("1.5"),
        F.lit(',"b":-2,"prior_shift":0},"suppression":{"applied":'), F.when(n % 3 == 0, "true").otherwise("false"), F.lit(',"logit_below":-3,"rank_above":'), F.when(n % 13 == 0, "null").otherwise("0.5"), F.lit(',"multiply_by":0.5}}'),
    )
    some = F.concat(F.when((n % 5 == 0) | (n % 17 == 0), F.concat(F.lit('"alpha":'), alpha, F.lit(","))).otherwise(""), F.when((n % 5 != 0) | (n % 17 == 0), weights).otherwise(""))
    document = F.when(n % 29 == 0, '{"weights": ').when(n % 31 == 0, "[1]").otherwise(F.concat(F.lit("{"), some, rest))
    d = table(spark, sf_dir, "documents").filter("n_chars is not null").select("doc_id", document.alias("document"))
    return d.select("doc_id", expect.constants_problem(F.col("document"), ("s1", "s2", "s3")).alias("problem"))


# hashes and stamps


@query("pcm_hashes", "SELECT 'doc/'||doc_id AS path, sha256(unhex(substr(hex(encode(text)), 1, octet_length(encode(text))//2*4))) AS pcm, octet_length(encode(text))//2 AS n_samples FROM documents WHERE doc_id%10<>9")
def pcm_hashes(spark, sf_dir):
    """Hash of the samples of each recording, whatever its header says beside them; no other file has one."""
    c = clips(spark, sf_dir).filter(F.substring("content", 1, 4) == F.lit(b"RIFF"))
    pcm = F.substring("content", 45, 2**31 - 1)
    of = lambda c: F.when(F.col("given"), c)
    return c.select("path", of(F.sha2(pcm, 256)).alias("pcm"), of(F.floor(F.octet_length(pcm) / 2).cast("long")).alias("n_samples"))


@query("run_stamps", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%d-%H%M%S')||'-'||substr(sha256(event_type),1,8) AS run FROM events")
def run_stamps(spark, sf_dir):
    """Sortable stamps and ISO times of events, and run names made of a stamp and a short hash."""
    stamp = F.date_format("ts", "yyyyMMdd-HHmmss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"), iso.alias("iso"), F.concat(stamp, F.lit("-"), F.substring(F.sha2("event_type", 256), 1, 8)).alias("run"))


# rules on gains, probes under noise

GAINS_SQL = f"""WITH {EV}, sc AS (SELECT candidate, split, y, round(score,9) AS score FROM scores WHERE y IS NOT NULL){DCF_SQL.format(k="candidate, split", **BRIEF_SQL)}{BOTH_SQL.format(k="candidate, split")},
c AS (SELECT candidate, max(round(min_dcf,4)) FILTER (split='itw') AS wb, max(round(averse,4)) FILTER (split='itw') AS wa, max(round(min_dcf,4)) FILTER (split='holdout') AS hb, max(round(min_dcf,4)) FILTER (split='inner_oof') AS ib FROM dcf JOIN pair USING (candidate, split) GROUP BY 1),
k AS (SELECT 's2' AS candidate, count(*) FILTER (s1<0 AND s2>=0) AS catches FROM ev WHERE split='itw' AND y=1 UNION ALL SELECT 's3', count(*) FILTER (s1<0 AND s3>=0) FROM ev WHERE split='itw' AND y=1),
g AS (SELECT candidate, o.wb-n.wb AS itw_brief, o.wa-n.wa AS itw_averse, o.hb-n.hb AS holdout_brief, o.ib-n.ib AS inner_brief, catches FROM k JOIN c n USING (candidate), (SELECT * FROM c WHERE candidate='s1') o),
f AS (SELECT *, concat_ws(',', CASE WHEN itw_brief >= 0.03e0-1e-12 THEN NULL ELSE 'itw_brief_gain' END, CASE WHEN itw_averse >= 0.03e0-1e-12 THEN NULL ELSE 'itw_averse_gain' END, CASE WHEN catches>=19 THEN NULL ELSE 'catches' END) AS room_failed,
 concat_ws(',', CASE WHEN itw_brief >= 0.01e0-1e-12 THEN NULL ELSE 'itw_brief_gain' END, CASE WHEN itw_averse >= -0.01e0-1e-12 THEN NULL ELSE 'itw_averse_reg' END, CASE WHEN holdout_brief >= -0.05e0-1e-12 THEN NULL ELSE 'holdout_brief_reg' END, CASE WHEN inner_brief >= -0.03e0-1e-12 THEN NULL ELSE 'inner_brief_reg' END) AS standing_failed FROM g)
SELECT candidate, round(itw_brief,4) AS itw_brief, round(itw_averse,4) AS itw_averse, round(holdout_brief,4) AS holdout_brief, round(inner_brief,4) AS inner_brief, catches, room_failed, standing_failed, CASE room_failed WHEN '' THEN 'PASS' ELSE 'FAIL' END AS room, CASE standing_failed WHEN '' THEN 'PASS' ELSE 'FAIL' END AS standing FROM f"""


@query("room_rules", GAINS_SQL)
def room_rules(spark, sf_dir):
    """What each candidate gains over the first detector, which rules of room and of the standing rule it fails."""
    d = ru.ruled(ru.gains(evaluation(spark, sf_dir), ["s2", "s3"], "s1"))
    four = [F.round(c, 4).alias(c) for c in ("itw_brief", "itw_averse", "holdout_brief", "inner_brief")]
    return d.select("candidate", *four, "catches", "room_failed", "standing_failed", "room", "standing")


#: Candidates that are probed; the last has no column in the table.
PROBED = ("s1", "s2", "s3", "s4")
NOISY_SQL = "b AS (SELECT doc_id, path, y, candidate, k.kind, CASE WHEN candidate='s4' OR (k.kind='noise20' AND doc_id%41=0) THEN NULL ELSE round(CASE k.kind WHEN 'none' THEN s ELSE s+m3/4e0 END,9) END AS score FROM (SELECT doc_id, path, y, m3, 's1' AS candidate, s1 AS s FROM ev WHERE split='holdout' UNION ALL SELECT doc_id, path, y, m3, 's2', s2 FROM ev WHERE split='holdout' UNION ALL SELECT doc_id, path, y, m3, 's3', s3 FROM ev WHERE split='holdout' UNION ALL SELECT doc_id, path, y, m3, 's4', NULL FROM ev WHERE split='holdout'), (SELECT unnest(['none','noise20']) AS kind) k), sc AS (SELECT * FROM b WHERE score IS NOT NULL)"
PROBE_SQL = f"WITH {EV}, {NOISY_SQL}{DCF_SQL.format(k='candidate, kind', **BRIEF_SQL)}{BOTH_SQL.format(k='candidate, kind')}, au AS (SELECT candidate, kind, sum(pos*(nn-fp+neg/2e0))/nullif(max(np)*max(nn),0) AS auc FROM rocs GROUP BY ALL), cell AS (SELECT candidate, kind, count(score) AS n, count(*)-count(score) AS n_errors, max(auc) AS auc, max(min_dcf) AS brief, max(averse) AS averse FROM b LEFT JOIN dcf USING (candidate, kind) LEFT JOIN pair USING (candidate, kind) LEFT JOIN au USING (candidate, kind) GROUP BY ALL)"


def _noisy(spark, sf_dir):
    """(path, y, candidate, kind, score) of the holdout, clean and with noise, under which some rows can't be scored."""
    held = ru.with_columns_of(evaluation(spark, sf_dir).filter("split = 'holdout'"), {c: "double" for c in PROBED})
    broken = F.col("doc_id") % 41 == 0
    made = [F.struct(F.lit(c).alias("candidate"), F.lit(k).alias("kind"), s.alias("score")) for c in PROBED for k, s in (("none", F.round(c, 9)), ("noise20", F.when(~broken, F.round(F.col(c) + F.col("m3") / 4.0, 9))))]
    return held.select("path", "y", F.explode(F.array(*made)).alias("m")).select("path", "y", "m.*")


@query("noise_probe", PROBE_SQL + " SELECT candidate, kind, n, n_errors, round(auc,6) AS auc, round(brief,6) AS brief, round(averse,6) AS averse FROM cell")
def noise_probe(spark, sf_dir):
    """Metrics of every candidate on clean rows and under noise; one that was never scored has errors only."""
    return ru.probe_cells(_noisy(spark, sf_dir)).select("candidate", "kind", "n", "n_errors", R6("auc"), R6("brief"), R6("averse"))


@query(
    "noise_verdict",
    PROBE_SQL + """, w AS (SELECT candidate, max(auc) FILTER (kind='none') AS clean, max(auc) FILTER (kind='noise20') AS noisy FROM cell GROUP BY 1), r AS (SELECT clean AS known FROM w WHERE candidate='s1'),
 d AS (SELECT b.candidate, count(*) AS n, max(abs(b.score-round(v.score,9))) AS drift FROM b JOIN scores v ON v.path=b.path AND v.candidate=b.candidate WHERE b.kind='none' AND b.score IS NOT NULL GROUP BY 1)
 SELECT candidate, round(clean,6) AS clean_auc, round(noisy,6) AS noisy_auc, CASE WHEN clean IS NULL OR noisy IS NULL OR known IS NULL THEN 'inconclusive' WHEN noisy >= 0.5e0 AND clean >= known-0.005e0-1e-12 THEN 'PASS' ELSE 'FAIL' END AS reading, coalesce(n,0) AS n_checked, round(drift,9) AS drift FROM w LEFT JOIN d USING (candidate), r""",
)
def noise_verdict(spark, sf_dir):
    """Whether a candidate stands noise and is as good as the first one without, with a check against stored scores."""
    cells = settled(_noisy(spark, sf_dir))
    read = ru.probe_reading(settled(ru.probe_cells(cells)), "none", "noise20", "s1", 0.5, 0.005)
    stored = long_scores(evaluation(spark, sf_dir)).withColumn("score", F.round("score", 9))
    checked = ru.self_check(cells.filter("kind = 'none'"), stored, ["path", "candidate"], "candidate")
    both = read.join(checked, "candidate", "left")
    return both.select("candidate", R6("clean_auc"), R6("noisy_auc"), "reading", F.coalesce("n", F.lit(0)).alias("n_checked"), F.round("drift", 9).alias("drift"))
