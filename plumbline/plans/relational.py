"""Queries of the relational family: projections, joins, aggregations, set operations, seeded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as sc
from plumbline.functions.prefix import quantiles
from plumbline.operators import expect, relations as rel
from plumbline.sources.tables import EV, evaluation, table

QUERIES, ORACLES = {}, {}
W = f"WITH {EV} "


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# Projections and predicates


@query("label_normalise", "SELECT c_custkey, replace(lower(c_mktsegment), '-', '') AS label FROM customer")
def label_normalise(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sc.label_normalised(F.col("c_mktsegment")).alias("label"))


@query(
    "group_key",
    W + "SELECT path, CASE WHEN y=1 THEN 'gen:'||generator WHEN source='src3' THEN 'lj:'||substr(path,1,5) ELSE 'spk:'||speaker END AS group_key, 'source:'||CASE WHEN y=1 THEN generator ELSE speaker END AS extra_key FROM ev",
)
def group_key(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    label = F.when(F.col("y") == 1, "spoof").otherwise("bonafide")
    speaker = F.when(F.col("source") == "src3", "ljspeech").otherwise(F.col("speaker"))
    return ev.select("path", sc.group_key(label, F.col("generator"), speaker, F.col("path")).alias("group_key"), F.concat(F.lit("source:"), F.when(F.col("y") == 1, F.col("generator")).otherwise(F.col("speaker"))).alias("extra_key"))


@query("row_id", W + "SELECT path, source||'_'||substr(sha1(path),1,12) AS id FROM ev")
def row_id(spark, sf_dir):
    return evaluation(spark, sf_dir).select("path", sc.row_id(F.col("source"), F.col("path")).alias("id"))


@query("path_columns", "SELECT page_id, split_part(url,'/',3) AS host, split_part(split_part(url,'://',2),'/',2) AS area, array_length(string_split(url,'/')) AS depth FROM pages")
def path_columns(spark, sf_dir):
    parts = F.split("url", "/")
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(parts, 3).alias("host"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("area"), F.size(parts).cast("long").alias("depth"))


#: Families left out of a fold's training rows. Fixed values.
FAMILIES = [("0", "BRASS"), ("0", "TIN"), ("1", "STEEL"), ("2", "COPPER"), ("2", "NICKEL")]
FAM_SQL = "fam(fold, term) AS (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in FAMILIES) + ")"


@query(
    "family_exclusion",
    f"WITH {FAM_SQL}, p AS (SELECT p_partkey, p_type, (p_partkey%5)::VARCHAR AS fold FROM part) SELECT p_partkey, fold FROM p WHERE NOT EXISTS (SELECT 1 FROM fam WHERE fam.fold=p.fold AND contains(upper(p.p_type), fam.term))",
)
def family_exclusion(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", (F.col("p_partkey") % 5).cast("string").alias("fold"))
    return rel.without_families(p, FAMILIES, "fold", "p_type").select("p_partkey", "fold")


@query(
    "training_rows",
    f"WITH {EV}, {FAM_SQL} SELECT path, k.fold AS k FROM ev, (SELECT DISTINCT fold FROM ev WHERE split='inner_oof') k WHERE ev.split='inner_oof' AND ev.fold<>k.fold AND NOT EXISTS (SELECT 1 FROM fam WHERE fam.fold=k.fold AND contains(upper(ev.source), fam.term))",
)
def training_rows(spark, sf_dir):
    ev = evaluation(spark, sf_dir).filter("split = 'inner_oof'")
    folds = ev.select(F.col("fold").alias("k")).distinct()
    rows = ev.join(F.broadcast(folds), F.col("fold") != F.col("k"))
    return rel.without_families(rows, FAMILIES, "k", "source").select("path", "k")


@query("complete_rows", "SELECT event_id FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AND value/nullif(user_id%3,0) IS NOT NULL")
def complete_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("part", F.col("value") / F.expr("nullif(user_id % 3, 0)"))
    return e.filter(sc.finite(F.col("value"), F.col("part"))).select("event_id")


@query("verdict", W + "SELECT path, CASE WHEN n_chars < 300 THEN 'undetermined' WHEN s2 >= 0.5e0 THEN 'synthetic' ELSE 'bonafide' END AS verdict FROM ev")
def verdict(spark, sf_dir):
    from plumbline.operators.fusion import verdict as rule

    return evaluation(spark, sf_dir).select("path", rule(F.lit(True), F.col("n_chars") >= 300, F.col("s2")).alias("verdict"))


@query("duration_floor", "SELECT event_id FROM events WHERE try_cast(json_extract_string(props,'$.k') AS DOUBLE) >= 50")
def duration_floor(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k").try_cast("double") >= 50).select("event_id")


@query("json_extract", "SELECT event_id, try_cast(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("jitter", W + "SELECT path, round(s2,9) AS s2, round(m3,9) AS m3 FROM ev")
def jitter(spark, sf_dir):
    return evaluation(spark, sf_dir).select("path", F.round("s2", 9).alias("s2"), F.round("m3", 9).alias("m3"))


@query(
    "scalar_maps",
    W + "SELECT path, round(1e0/(1e0+exp(-s1)),6) AS p, round(ln(greatest(1e-6,least(1-1e-6,1e0/(1e0+exp(-m3))))/(1e0-greatest(1e-6,least(1-1e-6,1e0/(1e0+exp(-m3)))))),6) AS back, round(10e0*log10(greatest(1e-12::DOUBLE, n_chars/1e6)),6) AS db, round(0.001e0+0.999e0*greatest(0e0,least(1e0,s3)),6) AS d FROM ev",
)
def scalar_maps(spark, sf_dir):
    p = sc.sigmoid(F.col("m3"))
    return evaluation(spark, sf_dir).select("path", F.round(sc.sigmoid(F.col("s1")), 6).alias("p"), F.round(sc.logit(p), 6).alias("back"), F.round(sc.decibels(F.col("n_chars") / 1e6), 6).alias("db"), F.round(sc.determinate(F.col("s3")), 6).alias("d"))


_ENCODER = "CASE p_partkey%7 WHEN 0 THEN 'ElevenLabs v2' WHEN 1 THEN 'my TTS engine' WHEN 2 THEN 'Mattsson' WHEN 3 THEN 'XTTS' ELSE 'Lavf' END"
_COMMENT = "CASE WHEN p_partkey%5=0 THEN 'An AI-Generated part' ELSE p_type END"
_TERMS = lambda terms: "coalesce(" + ", ".join(f"CASE WHEN {'regexp_matches(t, ' + chr(39) + chr(92) + 'btts' + chr(92) + 'b' + chr(39) + ')' if x == 'tts' else f'contains(t, {chr(39)}{x}{chr(39)})'} THEN '{x}' END" for x in terms) + ")"
TAG_SQL = f"WITH g AS (SELECT p_partkey, {_ENCODER} AS e, {_COMMENT} AS c, p_name AS n FROM part), t AS (SELECT *, lower(c||' '||e||' '||n) AS t FROM g), r AS (SELECT *, {_TERMS(sc.AI_TOOL_TERMS)} AS tool, {_TERMS(sc.SYNTH_TERMS)} AS made FROM t) SELECT p_partkey, CASE WHEN tool IS NOT NULL THEN 0.9e0 WHEN made IS NOT NULL THEN 0.75e0 ELSE 0.5e0 END AS score, coalesce(tool, made) AS term, 'comment='||c||'|encoder='||e||'|title='||n AS tags FROM r"


@query("tag_rules", TAG_SQL)
def tag_rules(spark, sf_dir):
    """What the tags of a file say of how it was made: a tool's name, a word for making, or nothing."""
    n = F.col("p_partkey")
    encoder = F.when(n % 7 == 0, "ElevenLabs v2").when(n % 7 == 1, "my TTS engine").when(n % 7 == 2, "Mattsson").when(n % 7 == 3, "XTTS").otherwise("Lavf")
    comment = F.when(n % 5 == 0, "An AI-Generated part").otherwise(F.col("p_type"))
    tags = F.create_map(F.lit("title"), F.col("p_name"), F.lit("encoder"), encoder, F.lit("comment"), comment)
    score, term = sc.tag_score(F.col("tags"))
    return table(spark, sf_dir, "part").select("p_partkey", tags.alias("tags")).select("p_partkey", score.alias("score"), term.alias("term"), sc.sorted_pairs(F.col("tags")).alias("tags"))


@query("container_facts", "SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, contains(html, '</html>') AS whole, octet_length(encode(html)) AS n_bytes, split_part(url,'://',1) AS scheme FROM pages")
def container_facts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.col("html").contains("</html>").alias("whole"), F.octet_length("html").cast("long").alias("n_bytes"), F.split("url", "://").getItem(0).alias("scheme"))


@query("file_hashes", "SELECT doc_id, sha256(text) AS sha, doc_id||':'||substr(sha256(text),1,8) AS tag FROM documents")
def file_hashes(spark, sf_dir):
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("sha"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.substring(h, 1, 8)).alias("tag"))


@query("spec_parse", "SELECT o_orderkey, split_part(o_orderpriority,'-',1)::INT AS level, split_part(o_orderpriority,'-',2) AS word FROM orders")
def spec_parse(spark, sf_dir):
    p = F.split("o_orderpriority", "-")
    return table(spark, sf_dir, "orders").select("o_orderkey", p.getItem(0).cast("int").alias("level"), p.getItem(1).alias("word"))


@query(
    "evidence_text",
    W + "SELECT path, 'level '||floor(round(s2*100,6))::BIGINT::VARCHAR||', '||n_chars::VARCHAR||' characters'||CASE WHEN m3 < -3e0 THEN '; guarded' ELSE '' END AS evidence, CASE WHEN n_chars<1024 THEN n_chars||' B' ELSE round(n_chars/1024e0,1)::DECIMAL(12,1)||' KB' END AS size FROM ev",
)
def evidence_text(spark, sf_dir):
    text = F.concat(F.lit("level "), F.floor(F.round(F.col("s2") * 100, 6)).cast("string"), F.lit(", "), F.col("n_chars").cast("string"), F.lit(" characters"), F.when(F.col("m3") < -3, "; guarded").otherwise(""))
    return evaluation(spark, sf_dir).select("path", text.alias("evidence"), sc.human_size(F.col("n_chars")).alias("size"))


@query(
    "routing_log",
    W + "SELECT path, concat_ws(' | ', CASE WHEN n_chars<300 THEN 'gate: not speech' END, CASE WHEN m3 < -3e0 THEN 'guard: below' END, CASE WHEN y IS NOT NULL THEN 'label: '||y END, 'fold: '||fold) AS log FROM ev",
)
def routing_log(spark, sf_dir):
    lines = F.array(F.when(F.col("n_chars") < 300, "gate: not speech"), F.when(F.col("m3") < -3, "guard: below"), F.when(F.col("y").isNotNull(), F.concat(F.lit("label: "), F.col("y").cast("string"))), F.concat(F.lit("fold: "), F.col("fold")))
    return evaluation(spark, sf_dir).select("path", F.array_join(F.filter(lines, lambda x: x.isNotNull()), " | ").alias("log"))


# Joins


@query("join_inner_labels", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def join_inner_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")


@query("join_left_labels", "SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("join_basename_fallback", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON 'doc/'||d.doc_id = 'doc/'||l.doc_id")
def join_basename_fallback(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    return rel.left_by_path_or_name(files, labels, "path", "id").select("doc_id", "quality")


@query(
    "multiway_common_rows",
    W + "SELECT path, split FROM (SELECT path, split FROM ev WHERE s1 > -1) a JOIN (SELECT path, split FROM ev WHERE s2 > -2) b USING (path, split) JOIN (SELECT path, split FROM ev WHERE s3 > -3) c USING (path, split)",
)
def multiway_common_rows(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    return rel.common_rows([ev.filter(f"s{k} > -{k}").select("path", "split") for k in (1, 2, 3)], ["path", "split"])


@query("semi_leak", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id AND l.toxic=1)")
def semi_leak(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("anti_leak", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id)")
def anti_leak(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("inherit_fold", W + ", g AS (SELECT generator, min(fold) AS fold FROM ev WHERE split='inner_oof' GROUP BY 1) SELECT ev.path, g.fold FROM ev JOIN g USING (generator) WHERE ev.split='itw'")
def inherit_fold(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    folds = ev.filter("split = 'inner_oof'").groupBy("generator").agg(F.min("fold").alias("fold"))
    return ev.filter("split = 'itw'").drop("fold").join(folds, "generator").select("path", "fold")


@query("reindex_fill", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def reindex_fill(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return rel.aligned(table(spark, sf_dir, "customer").select("c_custkey"), n, "c_custkey", {"n": 0})


@query(
    "pairwise_cosine",
    "WITH v AS (SELECT vec_id, vec_id//4 AS clip, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(list_sum(list_transform(list_zip(a.e,b.e), lambda p: p[1]*p[2]))/((sqrt(list_sum(list_transform(a.e, lambda x: x*x)))+1e-9)*(sqrt(list_sum(list_transform(b.e, lambda x: x*x)))+1e-9)),5) AS cos FROM v a JOIN v b ON a.clip=b.clip AND a.vec_id<b.vec_id",
)
def pairwise_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("clip"), F.col("embedding").cast("array<double>").alias("e"))
    a, b = v.alias("a"), v.alias("b")
    return a.join(b, (F.col("a.clip") == F.col("b.clip")) & (F.col("a.vec_id") < F.col("b.vec_id"))).select(F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"), F.round(sc.cosine(F.col("a.e"), F.col("b.e")), 5).alias("cos"))


@query("paired_conditions", "SELECT o_custkey, a, b FROM (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus='O') AS a, max(o_totalprice) FILTER (o_orderstatus='F') AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_conditions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["O", "F"]).agg(F.max("o_totalprice"))
    return o.select("o_custkey", F.col("O").alias("a"), F.col("F").alias("b")).dropna()


@query("cross_grid", "SELECT r_name, v FROM region, (SELECT unnest(['clean','mp3','noise']) AS v)")
def cross_grid(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_name", F.explode(F.array(F.lit("clean"), F.lit("mp3"), F.lit("noise"))).alias("v"))


@query("template_missing", W + "SELECT path, coalesce(s, 0.0001e0) AS score, s IS NULL AS missing FROM (SELECT path, CASE WHEN doc_id%7=0 THEN NULL ELSE round(s2,6) END AS s FROM ev)")
def template_missing(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    have = ev.filter("doc_id % 7 <> 0").select("path", F.round("s2", 6).alias("s"))
    return ev.select("path").join(have, "path", "left").select("path", F.coalesce("s", F.lit(0.0001)).alias("score"), F.col("s").isNull().alias("missing"))


@query("template_resolve", W + ", t AS (SELECT DISTINCT speaker||'/'||path AS want, path FROM ev) SELECT want, path AS found FROM t UNION ALL SELECT 'none/x'||doc_id, NULL FROM ev")
def template_resolve(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    wanted = ev.select(F.concat_ws("/", "speaker", "path").alias("want"))
    wanted = wanted.union(ev.select(F.concat(F.lit("none/x"), F.col("doc_id"))))
    return rel.resolved(wanted, ev.select("path"), "want", "path")


@query("fold_agreement", W + "SELECT count(*) AS n_bad FROM ev a JOIN ev b USING (path) WHERE a.fold <> b.fold")
def fold_agreement(spark, sf_dir):
    ev = evaluation(spark, sf_dir).select("path", "fold")
    return ev.alias("a").join(ev.alias("b"), "path").filter("a.fold <> b.fold").agg(F.count("*").alias("n_bad"))


@query("band_lookup", W + ", b(lo,hi,action) AS (VALUES (-1e9,-1e0,'keep'),(-1e0,0e0,'watch'),(0e0,1e0,'retry'),(1e0,1e9,'drop')) SELECT path, action FROM ev JOIN b ON s2 >= lo AND s2 < hi")
def band_lookup(spark, sf_dir):
    bands = spark.createDataFrame([(-1e9, -1.0, "keep"), (-1.0, 0.0, "watch"), (0.0, 1.0, "retry"), (1.0, 1e9, "drop")], "lo double, hi double, action string")
    return evaluation(spark, sf_dir).join(F.broadcast(bands), F.expr("s2 >= lo and s2 < hi")).select("path", "action")


# Aggregations


@query("fold_counts_pivot", W + "SELECT fold, count(*) FILTER (y=0) AS bonafide, count(*) FILTER (y=1) AS spoof FROM ev GROUP BY fold")
def fold_counts_pivot(spark, sf_dir):
    p = evaluation(spark, sf_dir).withColumn("label", F.when(F.col("y") == 1, "spoof").when(F.col("y") == 0, "bonafide"))
    return p.groupBy("fold").pivot("label", ["bonafide", "spoof"]).count().na.fill(0)


@query("group_nunique", W + "SELECT y, source, count(*) AS n, count(DISTINCT speaker) AS speakers FROM ev GROUP BY y, source")
def group_nunique(spark, sf_dir):
    return evaluation(spark, sf_dir).groupBy("y", "source").agg(F.count("*").alias("n"), F.count_distinct("speaker").alias("speakers"))


@query("crosstab_class", "SELECT p_brand, count(*) FILTER (p_size<=10) AS small, count(*) FILTER (p_size>10) AS large FROM part GROUP BY 1")
def crosstab_class(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("c", F.when(F.col("p_size") <= 10, "small").otherwise("large"))
    return p.groupBy("p_brand").pivot("c", ["small", "large"]).count().na.fill(0)


@query("describe_by_group", "SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal),4) AS mean, round(stddev_samp(c_acctbal),4) AS std, min(c_acctbal) AS low, round(quantile_cont(c_acctbal,0.25),4) AS q1, round(quantile_cont(c_acctbal,0.5),4) AS q2, round(quantile_cont(c_acctbal,0.75),4) AS q3, max(c_acctbal) AS high FROM customer GROUP BY 1")
def describe_by_group(spark, sf_dir):
    x = F.col("c_acctbal")
    q = [F.round(F.percentile(x, p), 4).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("low"), *q, F.max(x).alias("high"))


@query("median_by_group", "SELECT l_returnflag, quantile_cont(l_quantity,0.5) AS q, quantile_cont(l_discount,0.5) AS d FROM lineitem GROUP BY 1")
def median_by_group(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.5).alias("q"), F.percentile("l_discount", 0.5).alias("d"))


@query("value_counts", W + "SELECT y, count(*) AS n FROM ev GROUP BY y")
def value_counts(spark, sf_dir):
    return evaluation(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n"))


@query("count_distinct", "SELECT count(DISTINCT l_quantity) AS q, count(DISTINCT l_partkey) AS p, count(DISTINCT l_shipdate) AS d FROM lineitem")
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(*[F.count_distinct(c).alias(a) for a, c in (("q", "l_quantity"), ("p", "l_partkey"), ("d", "l_shipdate"))])


@query("share_above", W + "SELECT split, round(avg((s2 > 0)::INT),6) AS strict, round(avg((s3 >= 0)::INT),6) AS loose FROM ev GROUP BY split")
def share_above(spark, sf_dir):
    return evaluation(spark, sf_dir).groupBy("split").agg(F.round(F.avg((F.col("s2") > 0).cast("int")), 6).alias("strict"), F.round(F.avg((F.col("s3") >= 0).cast("int")), 6).alias("loose"))


@query("confusion_2x2", W + "SELECT split, count(*) FILTER (y=1 AND s2>=0) AS tp, count(*) FILTER (y=0 AND s2>=0) AS fp, count(*) FILTER (y=1 AND s2<0) AS fn, count(*) FILTER (y=0 AND s2<0) AS tn FROM ev GROUP BY split")
def confusion_2x2(spark, sf_dir):
    cells = {"tp": "y = 1 and s2 >= 0", "fp": "y = 0 and s2 >= 0", "fn": "y = 1 and s2 < 0", "tn": "y = 0 and s2 < 0"}
    return evaluation(spark, sf_dir).groupBy("split").agg(*[F.count_if(F.expr(e)).alias(k) for k, e in cells.items()])


@query("group_leak", W + "SELECT max(n) AS most_folds, count(*) FILTER (n>1) AS n_leaking FROM (SELECT speaker, count(DISTINCT fold) AS n FROM ev WHERE split='inner_oof' GROUP BY 1)")
def group_leak(spark, sf_dir):
    n = evaluation(spark, sf_dir).filter("split = 'inner_oof'").groupBy("speaker").agg(F.count_distinct("fold").alias("n"))
    return n.agg(F.max("n").alias("most_folds"), F.count_if(F.col("n") > 1).alias("n_leaking"))


GAP_SQL = W + ", u AS (SELECT generator, 's1' AS f, s1 AS v FROM ev UNION ALL SELECT generator, 's2', s2 FROM ev UNION ALL SELECT generator, 's3', s3 FROM ev), g AS (SELECT generator, f, quantile_cont(v,0.5) AS m FROM u GROUP BY ALL), a AS (SELECT f, quantile_cont(v,0.5) AS m, quantile_cont(v,0.75)-quantile_cont(v,0.25) AS iqr FROM u GROUP BY f)"


def medians(spark, sf_dir):
    u = evaluation(spark, sf_dir).select("generator", "s1", "s2", "s3").unpivot(["generator"], ["s1", "s2", "s3"], "f", "v")
    a = u.groupBy("f").agg(F.percentile("v", 0.5).alias("all"), (F.percentile("v", 0.75) - F.percentile("v", 0.25)).alias("iqr"))
    return u.groupBy("generator", "f").agg(F.percentile("v", 0.5).alias("m")).join(a, "f")


@query("match_distance", GAP_SQL + " SELECT generator, round(avg(abs(g.m-a.m)/a.iqr),6) AS distance, count(*) AS n_stats FROM g JOIN a USING (f) WHERE iqr > 1e-9 GROUP BY 1")
def match_distance(spark, sf_dir):
    return medians(spark, sf_dir).filter("iqr > 1e-9").groupBy("generator").agg(F.round(F.avg(F.abs(F.col("m") - F.col("all")) / F.col("iqr")), 6).alias("distance"), F.count("*").alias("n_stats"))


@query("feature_position", GAP_SQL + " SELECT f, round((max(m) FILTER (generator='fr')-max(m) FILTER (generator='en'))/nullif(max(m) FILTER (generator='de')-max(m) FILTER (generator='en'),0),6) AS position FROM g GROUP BY f")
def feature_position(spark, sf_dir):
    m = medians(spark, sf_dir).groupBy("f").pivot("generator", ["en", "de", "fr"]).agg(F.max("m"))
    return m.select("f", F.round((F.col("fr") - F.col("en")) / F.expr("nullif(de - en, 0)"), 6).alias("position"))


@query("failure_gate", W + "SELECT split, count(*) AS n, count(*) FILTER (n_chars<100) AS not_ok, 100*count(*) FILTER (n_chars<100) > 5*count(*) AS fails FROM ev GROUP BY split")
def failure_gate(spark, sf_dir):
    bad = F.count_if(F.col("n_chars") < 100)
    return evaluation(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), bad.alias("not_ok"), (100 * bad > 5 * F.count("*")).alias("fails"))


@query("dup_hash_groups", "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text<>'' GROUP BY 1 HAVING count(*)>1")
def dup_hash_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text <> ''").groupBy(F.sha2("text", 256).alias("sha"))
    return d.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("pivot_kinds", "SELECT user_id, max(value) FILTER (event_type='click') AS click, max(value) FILTER (event_type='view') AS view, max(value) FILTER (event_type='absent') AS absent FROM events GROUP BY 1")
def pivot_kinds(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "absent"]).agg(F.max("value"))


@query("duration_quantiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice,0.5),4) AS median, round(quantile_cont(o_totalprice,0.9),4) AS p90 FROM orders GROUP BY 1")
def duration_quantiles(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


@query("length_buckets", W + "SELECT CASE WHEN n_chars<=1000 THEN 'short' WHEN n_chars<=3000 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n, count(DISTINCT y) AS classes FROM ev WHERE y IS NOT NULL GROUP BY 1 HAVING count(*)>=20 AND count(DISTINCT y)=2")
def length_buckets(spark, sf_dir):
    b = F.when(F.col("n_chars") <= 1000, "short").when(F.col("n_chars") <= 3000, "middle").otherwise("long")
    return evaluation(spark, sf_dir).filter("y is not null").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes")).filter("n >= 20 and classes = 2")


@query("run_summary", "SELECT count(*) AS n, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS median, max(value) AS longest, count(*) FILTER (value>100) AS n_slow FROM events")
def run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("longest"), F.count_if(F.col("value") > 100).alias("n_slow"))
    return d.join(quantiles(e, "value", {"median": 0.5})).select("n", "mean", F.round("median", 6).alias("median"), "longest", "n_slow")


@query("scorer_errors", "SELECT role, count(*) FILTER (length(text)<40) AS errors, 100*count(*) FILTER (length(text)<40) > count(*) AS over_limit FROM conversations GROUP BY 1")
def scorer_errors(spark, sf_dir):
    bad = F.count_if(F.length("text") < 40)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(bad.alias("errors"), (100 * bad > F.count("*")).alias("over_limit"))


@query("topk_group_mean", "SELECT p_brand, round(avg(p_retailprice),4) AS mean FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 8")
def topk_group_mean(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    return m.orderBy(F.desc("m"), "p_brand").limit(8).select("p_brand", F.round("m", 4).alias("mean"))


@query("batch_summary", W + "SELECT count(*) AS total, count(*) FILTER (s2>=0.5e0) AS synthetic, round(avg((s2>=0.5e0)::INT),6) AS share FROM ev")
def batch_summary(spark, sf_dir):
    hit = F.col("s2") >= 0.5
    return evaluation(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(hit).alias("synthetic"), F.round(F.avg(hit.cast("int")), 6).alias("share"))


@query("inner_iqr", W + "SELECT round(quantile_cont(s2,0.75)-quantile_cont(s2,0.25),6) AS iqr FROM ev WHERE split='inner_oof'")
def inner_iqr(spark, sf_dir):
    q = quantiles(evaluation(spark, sf_dir).filter("split = 'inner_oof'"), "s2", {"q1": 0.25, "q3": 0.75})
    return q.select(F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"))


# Order, top-k, dedup, sets


@query("limit_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_ordered(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("lowest_fraction", W + ", r AS (SELECT path, row_number() OVER (ORDER BY round(s2,9), path) AS rn, count(*) OVER () AS n FROM ev) SELECT path FROM r WHERE rn <= round(0.7e0*n)")
def lowest_fraction(spark, sf_dir):
    return rel.lowest_fraction(evaluation(spark, sf_dir).withColumn("s2", F.round("s2", 9)), "s2", "path", 0.7).select("path")


@query("topk_abs", W + "SELECT path, round(m3,6) AS m3 FROM ev ORDER BY abs(m3) DESC, path LIMIT 15")
def topk_abs(spark, sf_dir):
    return evaluation(spark, sf_dir).orderBy(F.abs("m3").desc(), "path").limit(15).select("path", F.round("m3", 6).alias("m3"))


@query("argmin_struct", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size, p_partkey) AS rn FROM part) WHERE rn=1")
def argmin_struct(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_size", "p_partkey")).alias("p_partkey"))


@query("pareto_pick", "WITH c AS (SELECT p_brand, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY 1) SELECT p_brand FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.a<=x.a AND y.b<=x.b AND (y.a<x.a OR y.b<x.b))")
def pareto_pick(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    return rel.undominated(c, ["a", "b"]).select("p_brand")


@query("pick_mode", W + ", m AS (SELECT source, round(avg(s2),6) AS cost, round(avg(s3),6) AS skill FROM ev GROUP BY 1) SELECT source FROM m WHERE cost <= (SELECT min(cost) FROM m) + 0.02e0 ORDER BY skill DESC, source LIMIT 1")
def pick_mode(spark, sf_dir):
    m = evaluation(spark, sf_dir).groupBy("source").agg(F.round(F.avg("s2"), 6).alias("cost"), F.round(F.avg("s3"), 6).alias("skill"))
    near = m.join(F.broadcast(m.agg(F.min("cost").alias("best")))).filter("cost <= best + 0.02D")
    return near.orderBy(F.desc("skill"), "source").limit(1).select("source")


@query("cap_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn<=3")
def cap_per_group(spark, sf_dir):
    return rel.capped(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("cap_per_group_hash", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('0:'||p_partkey), p_partkey) AS rn FROM part) WHERE rn<=5")
def cap_per_group_hash(spark, sf_dir):
    return rel.sampled(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", 5).select("p_brand", "p_partkey")


@query("holdout_groups", W + ", g AS (SELECT DISTINCT speaker FROM ev WHERE y=0), r AS (SELECT speaker, row_number() OVER (ORDER BY md5('0:'||speaker), speaker) AS rn, count(*) OVER () AS n FROM g) SELECT path FROM ev WHERE speaker IN (SELECT speaker FROM r WHERE rn <= round(0.2e0*n))")
def holdout_groups(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    return ev.join(rel.drawn_groups(ev.filter("y = 0"), "speaker", 0.2), "speaker", "left_semi").select("path")


@query("bernoulli_subset", "SELECT p_partkey FROM part WHERE cast(('0x'||substr(sha1('0:'||p_partkey),1,16)) AS UBIGINT)::DOUBLE/18446744073709551616e0 < 0.3e0")
def bernoulli_subset(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(sc.jitter(F.concat(F.lit("0:"), F.col("p_partkey"))) < 0.3).select("p_partkey")


DURATION_SQL = ", r AS (SELECT doc_id, n_chars//500 AS bin, y, row_number() OVER (PARTITION BY n_chars//500, y ORDER BY md5('0:'||doc_id), doc_id) AS rn FROM ev WHERE y IS NOT NULL), c AS (SELECT bin, count(*) AS n FROM r WHERE y=0 GROUP BY 1) SELECT r.doc_id FROM r JOIN c USING (bin) WHERE y=1 AND rn <= n//20"


@query("duration_match", W + DURATION_SQL)
def duration_match(spark, sf_dir):
    ev = evaluation(spark, sf_dir).filter("y is not null").withColumn("bin", F.expr("n_chars div 500"))
    caps = ev.filter("y = 0").groupBy("bin").agg(F.expr("count(*) div 20").alias("cap"))
    pos = rel.sampled(ev.filter("y = 1"), ["bin"], "doc_id", None)
    return pos.join(caps, "bin").filter("_rank <= cap").select("doc_id")


@query("dedup_last", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn=1")
def dedup_last(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("dedup_first", "SELECT n_name AS name, min(prio) AS prio FROM (SELECT n_name, 0 AS prio FROM nation UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT n_name, 2 FROM nation) GROUP BY 1")
def dedup_first(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    parts = [n.select(F.col("n_name").alias("name")), r.select(F.col("r_name").alias("name")), n.select(F.col("n_name").alias("name"))]
    return rel.first_source(parts, ["name"])


@query("latest_wins", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn=1")
def latest_wins(spark, sf_dir):
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    return last.select("conv_id", "m.turn", "m.text")


@query("requested_keys", "SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_type IN ('click','view') GROUP BY ALL")
def requested_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = e.filter("event_type in ('click', 'view')").select("user_id", "event_type").distinct()
    return e.join(asked, ["user_id", "event_type"], "left_semi").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


@query("resume_antijoin", "SELECT vec_id FROM embeddings WHERE vec_id//100 NOT IN (SELECT DISTINCT vec_id//100 FROM embeddings WHERE vec_id%500=0)")
def resume_antijoin(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 100").alias("shard"))
    return e.join(e.filter("vec_id % 500 = 0").select("shard").distinct(), "shard", "left_anti").select("vec_id")


@query("union_export", W + "SELECT path, split, round(s1,6) AS score, NULL::INT AS y FROM ev WHERE split='test' UNION ALL SELECT path, split, round(s2,6), y FROM ev WHERE split='holdout'")
def union_export(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    test = ev.filter("split = 'test'").select("path", "split", F.round("s1", 6).alias("score"))
    return test.unionByName(ev.filter("split = 'holdout'").select("path", "split", F.round("s2", 6).alias("score"), "y"), allowMissingColumns=True)


@query("override_union", W + "SELECT path, split, round(CASE WHEN split='itw' THEN s3 ELSE s1 END,6) AS score FROM ev")
def override_union(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    base, new = ev.select("path", "split", F.round("s1", 6).alias("score")), ev.filter("split = 'itw'").select("path", "split", F.round("s3", 6).alias("score"))
    return rel.partition_replaced(base, new, "split")


@query("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("set_equality", "SELECT k, CASE WHEN bool_or(a) AND bool_or(b) THEN 'both' WHEN bool_or(a) THEN 'left' ELSE 'right' END AS side FROM (SELECT l_suppkey AS k, true AS a, false AS b FROM lineitem UNION ALL SELECT s_suppkey, false, true FROM supplier) GROUP BY k")
def set_equality(spark, sf_dir):
    return expect.sides(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query("set_disjoint", W + ", s AS (SELECT DISTINCT split, source||'/'||(doc_id%41) AS session FROM ev WHERE source IS NOT NULL) SELECT a.split AS one, b.split AS other, count(*) FILTER (a.session=b.session) AS n_shared FROM s a JOIN s b ON a.split<b.split GROUP BY ALL")
def set_disjoint(spark, sf_dir):
    """How many groups each pair of splits shares; none may."""
    s = evaluation(spark, sf_dir).filter("source is not null").select("split", F.concat_ws("/", "source", (F.col("doc_id") % 41).cast("string")).alias("session")).distinct()
    seen = s.groupBy("session").agg(F.sort_array(F.collect_set("split")).alias("splits"))  # a split is one of four
    pairs = F.expr("flatten(transform(splits, a -> transform(filter(splits, b -> a < b), b -> struct(a as one, b as other))))")
    shared = seen.select(F.explode(pairs).alias("p")).groupBy("p.one", "p.other").agg(F.count("*").alias("n"))
    kinds = s.select("split").distinct()
    every = kinds.withColumnRenamed("split", "one").join(kinds.withColumnRenamed("split", "other"), F.col("one") < F.col("other"))
    return every.join(shared, ["one", "other"], "left").select("one", "other", F.coalesce("n", F.lit(0)).alias("n_shared"))


@query("upsert_flagged", W + "SELECT path, round(CASE WHEN doc_id%9=0 THEN s3 ELSE s1 END,6) AS score, CASE WHEN doc_id%9=0 THEN '' ELSE 'kept' END AS flag FROM ev")
def upsert_flagged(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    old, new = ev.select("path", F.round("s1", 6).alias("score"), F.lit("kept").alias("flag")), ev.filter("doc_id % 9 = 0").select("path", F.round("s3", 6).alias("score"), F.lit("").alias("flag"))
    return rel.upserted(old, new, ["path"])


@query("domain_union", W + "SELECT 'inner' AS domain, count(*) AS n FROM ev WHERE split='inner_oof' UNION ALL SELECT 'wild', count(*) FROM ev WHERE split='itw' UNION ALL SELECT 'test', count(*) FROM ev WHERE split='test'")
def domain_union(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    parts = [ev.filter(F.col("split") == s).select(F.lit(d).alias("domain"), "path") for d, s in (("inner", "inner_oof"), ("wild", "itw"), ("test", "test"))]
    return reduce(DataFrame.unionByName, parts).groupBy("domain").agg(F.count("*").alias("n"))


@query("window_mean", "SELECT label, i AS pos, round(avg(e),5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(1,65)) AS i FROM embeddings) GROUP BY ALL")
def window_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "e"))
    return e.groupBy("label", (F.col("p") + 1).cast("long").alias("pos")).agg(F.round(F.avg("e"), 5).alias("mean"))


@query("embedding_scan", "SELECT count(*) AS n, min(vec_id) AS low, max(vec_id) AS high, count(DISTINCT vec_id)=max(vec_id)-min(vec_id)+1 AS gapless FROM embeddings")
def embedding_scan(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"), (F.count_distinct("vec_id") == F.max("vec_id") - F.min("vec_id") + 1).alias("gapless"))


@query("nested_lookup", "SELECT conv_id, max(text) FILTER (role='assistant' AND turn=1) AS first_reply FROM conversations GROUP BY 1")
def nested_lookup(spark, sf_dir):
    hit = F.when((F.col("role") == "assistant") & (F.col("turn") == 1), F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(hit).alias("first_reply"))


# Expectations


@query("submission_checks", W + "SELECT 'duplicate' AS problem, count(*)-count(DISTINCT path) AS n FROM ev UNION ALL SELECT 'not finite', count(*) FILTER (s2 IS NULL OR isnan(s2) OR isinf(s2)) FROM ev UNION ALL SELECT 'out of range', count(*) FILTER (NOT s2 BETWEEN 0e0 AND 1e0) FROM ev")
def submission_checks(spark, sf_dir):
    return expect.submission(evaluation(spark, sf_dir).select("path", F.col("s2").alias("score")), "path", "score", 0.0, 1.0)


@query("export_validate", W + "SELECT 'fold not text' AS problem, count(*) FILTER (fold NOT IN ('0','1','2','3','4','holdout','test')) AS n FROM ev UNION ALL SELECT 'group straddles', (SELECT count(*) FROM (SELECT speaker FROM ev WHERE split='inner_oof' GROUP BY 1 HAVING count(DISTINCT fold)>1)) UNION ALL SELECT 'no label', count(*) FILTER (y IS NULL AND split<>'test') FROM ev")
def export_validate(spark, sf_dir):
    return expect.export(evaluation(spark, sf_dir))


COHORT_SQL = """, want AS (SELECT CASE WHEN doc_id%10<6 THEN 'inner_oof' WHEN doc_id%10<8 THEN 'holdout' ELSE 'itw' END AS split, count(DISTINCT doc_id) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1 UNION ALL SELECT 'other', 1)
SELECT coalesce(w.split,h.split) AS split, coalesce(w.n,0)::BIGINT AS want, coalesce(h.n,0) AS have FROM (SELECT split, count(*) AS n FROM ev WHERE split<>'test' GROUP BY 1) h FULL JOIN want w USING (split)"""


@query("cohort_check", W + COHORT_SQL)
def cohort_check(spark, sf_dir):
    """Cohorts of the evaluation view against those that the labels alone ask for, and one that must not be there."""
    last = F.col("doc_id") % 10
    asked = table(spark, sf_dir, "labels").filter("toxic is not null").groupBy(F.when(last < 6, "inner_oof").when(last < 8, "holdout").otherwise("itw").alias("split"))
    want = asked.agg(F.count_distinct("doc_id").alias("want")).union(spark.createDataFrame([("other", 1)], "split string, want long"))
    return expect.cohort(evaluation(spark, sf_dir).filter("split <> 'test'"), ["split"], want)


@query("tolerance_check", "SELECT label, count(*) FILTER (abs(e-round(e,3)) > 1e-4+1e-3*abs(e)) AS n_off FROM (SELECT label, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY 1")
def tolerance_check(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("e"))
    return e.groupBy("label").agg(F.count_if(F.abs(F.col("e") - F.round("e", 3)) > 1e-4 + 1e-3 * F.abs("e")).alias("n_off"))


@query("fallback_flags", W + "SELECT path, CASE WHEN n_chars<50 THEN 'decode_error' WHEN m3>5.5e0 THEN 'score_error' ELSE '' END AS flag, CASE WHEN n_chars<50 OR m3>5.5e0 THEN 0.5e0 ELSE round(s2,6) END AS score FROM ev")
def fallback_flags(spark, sf_dir):
    flag = F.when(F.col("n_chars") < 50, "decode_error").when(F.col("m3") > 5.5, "score_error").otherwise("")
    return evaluation(spark, sf_dir).withColumn("flag", flag).select("path", "flag", F.when(F.col("flag") != "", 0.5).otherwise(F.round("s2", 6)).alias("score"))


ASSET_SQL = "WITH a AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id%11<>0), b AS (SELECT doc_id, CASE WHEN doc_id%13=0 THEN 'changed' ELSE sha256(text) END AS sha FROM documents WHERE doc_id%17<>0) SELECT CASE WHEN a.sha IS NULL THEN 'extra' WHEN b.sha IS NULL THEN 'missing' WHEN a.sha=b.sha THEN 'same' ELSE 'differs' END AS status, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1"


@query("asset_verify", ASSET_SQL)
def asset_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    seen = d.filter("doc_id % 17 <> 0").withColumn("sha", F.when(F.col("doc_id") % 13 == 0, "changed").otherwise(F.col("sha")))
    return expect.compared(d.filter("doc_id % 11 <> 0"), seen, "doc_id", "sha").groupBy("status").agg(F.count("*").alias("n"))


COLLISION_SQL = "WITH h AS (SELECT doc_id, sha256(text) AS sha, (['core','extra','test'])[doc_id%3+1] AS scope FROM documents) SELECT doc_id, scope, CASE scope WHEN 'extra' THEN 'dropped' ELSE 'reported' END AS action FROM h WHERE scope <> 'core' AND sha IN (SELECT sha FROM h WHERE scope='core' AND sha IS NOT NULL)"


@query("cross_scope_collision", COLLISION_SQL)
def cross_scope_collision(spark, sf_dir):
    """Contents of the core scope that stand in another one too: extras are dropped, test rows are reported."""
    scope = F.get(F.array(F.lit("core"), F.lit("extra"), F.lit("test")), (F.col("doc_id") % 3).cast("int"))
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), scope.alias("scope"))
    core = h.filter("scope = 'core'").select("sha").distinct()
    action = F.when(F.col("scope") == "extra", "dropped").otherwise("reported")
    return h.filter("scope <> 'core'").join(core, "sha", "left_semi").select("doc_id", "scope", action.alias("action"))


@query("latest_run", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus='F') WHERE rn=1")
def latest_run(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return done.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("stackable", W + "SELECT source, count(DISTINCT fold)=5 AS stackable FROM ev WHERE split='inner_oof' GROUP BY 1")
def stackable(spark, sf_dir):
    return evaluation(spark, sf_dir).filter("split = 'inner_oof'").groupBy("source").agg((F.count_distinct("fold") == 5).alias("stackable"))


@query("adjusted_count", W + ", r AS (SELECT avg((s2>=0)::INT) FILTER (y=1 AND split='inner_oof') AS tpr, avg((s2>=0)::INT) FILTER (y=0 AND split='inner_oof') AS fpr, avg((s2>=0)::INT) FILTER (split='test') AS q FROM ev) SELECT round(tpr,6) AS tpr, round(fpr,6) AS fpr, round(q,6) AS q, CASE WHEN tpr-fpr < 0.2e0 THEN 'refused: margin' ELSE 'ok' END AS status FROM r")
def adjusted_count(spark, sf_dir):
    hit = (F.col("s2") >= 0).cast("int")
    r = evaluation(spark, sf_dir).agg(F.avg(F.when(F.expr("y = 1 and split = 'inner_oof'"), hit)).alias("tpr"), F.avg(F.when(F.expr("y = 0 and split = 'inner_oof'"), hit)).alias("fpr"), F.avg(F.when(F.col("split") == "test", hit)).alias("q"))
    return r.select(*[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "q")], F.when(F.col("tpr") - F.col("fpr") < 0.2, "refused: margin").otherwise("ok").alias("status"))


@query("gate_rules", W + ", c AS (SELECT source, round(avg(s2) FILTER (split='inner_oof'),4) AS i, round(avg(s2) FILTER (split='itw'),4) AS w FROM ev GROUP BY 1), cur AS (SELECT i, w FROM c WHERE source='src0') SELECT c.source, c.i <= cur.i + 0.01e0 + 1e-12 AS inner_ok, c.w <= cur.w - 0.01e0 + 1e-12 AS wild_ok FROM c, cur WHERE c.i IS NOT NULL AND c.w IS NOT NULL")
def gate_rules(spark, sf_dir):
    c = evaluation(spark, sf_dir).groupBy("source").pivot("split", ["inner_oof", "itw"]).agg(F.round(F.avg("s2"), 4)).toDF("source", "i", "w")
    cur = c.filter("source = 'src0'").select(F.col("i").alias("ci"), F.col("w").alias("cw"))
    return c.dropna().join(F.broadcast(cur)).select("source", (F.col("i") <= F.col("ci") + 0.01 + 1e-12).alias("inner_ok"), (F.col("w") <= F.col("cw") - 0.01 + 1e-12).alias("wild_ok"))


@query("responds", W + ", s AS (SELECT generator, quantile_cont(abs(s2-s3),0.95) AS p95, count(*) AS n FROM ev GROUP BY 1), q AS (SELECT quantile_cont(s2,0.75)-quantile_cont(s2,0.25) AS iqr FROM ev WHERE split='inner_oof') SELECT generator, CASE WHEN n<20 THEN 'inconclusive' WHEN p95 > 0.1e0*iqr THEN 'responds' ELSE 'no response' END AS reading FROM s, q")
def responds(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    s = ev.groupBy("generator").agg(F.percentile(F.abs(F.col("s2") - F.col("s3")), 0.95).alias("p95"), F.count("*").alias("n"))
    q = quantiles(ev.filter("split = 'inner_oof'"), "s2", {"q1": 0.25, "q3": 0.75}).select((F.col("q3") - F.col("q1")).alias("iqr"))
    return s.join(F.broadcast(q)).select("generator", F.when(F.col("n") < 20, "inconclusive").when(F.col("p95") > 0.1 * F.col("iqr"), "responds").otherwise("no response").alias("reading"))


@query("shift_stats", W + "SELECT y, round(avg(s2-s3),6) AS mean, round(quantile_cont(s2-s3,0.5),6) AS median, round(quantile_cont(abs(s2-s3),0.95),6) AS p95, round(max(abs(s2-s3)),6) AS most FROM ev WHERE y IS NOT NULL GROUP BY 1")
def shift_stats(spark, sf_dir):
    d = F.col("s2") - F.col("s3")
    return evaluation(spark, sf_dir).filter("y is not null").groupBy("y").agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.percentile(d, 0.5), 6).alias("median"), F.round(F.percentile(F.abs(d), 0.95), 6).alias("p95"), F.round(F.max(F.abs(d)), 6).alias("most"))
