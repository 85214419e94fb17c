"""The stages one after the other, each against plain rules on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from plumbline.llm import decontam, mixing, simhash


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").union(spark.createDataFrame([(9_000_001, "12 34 !!", "en", "src0", 8), (9_000_002, None, "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
        if name != "shards":
            assert docs.columns == columns
    before, after = seen["language"]
    gone = {r["doc_id"] for r in before.select("doc_id").subtract(after.select("doc_id")).collect()}
    assert gone == {9_000_001, 9_000_002}
    before, after = seen["near_duplicates"]
    near = simhash.near_duplicates(before)
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in near.select("component_id").distinct().collect()}
    assert after.count() == after.select("doc_id").distinct().count() < before.count()
    before, after = seen["decontamination"]
    items = [set(decontam.windows_of(r["text"].encode())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = set().union(*items)
    clean = set()
    for r in before.collect():
        own = b" " + b" ".join(decontam.words_of(r["text"].encode())) + b" "
        if not any(w in own for w in windows):
            clean.add(r["doc_id"])
    assert {r[0] for r in after.select("doc_id").collect()} == clean
    before, after = seen["mixture"]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(before).filter("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
    before, after = seen["shards"]
    assert before.exceptAll(after.select(*columns)).count() == 0 and after.count() == before.count()
    sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and corpus_pipeline.ORACLE_SQL is None


def test_letterless_texts_go_without_labels_too(spark):
    texts = ["a", "12 é", "мир", "12 34 !?", " \n", "", None, "☃ ٣"]
    docs = spark.createDataFrame([(k, t, None, "a", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.in_a_language(spark, docs, "").collect()} == {0, 1, 2}


def test_stages_on_an_empty_table_and_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit("x") for c in ("score", "lang_pred", "n_words", "copies", "taken")})
    for table in (docs.filter("false"), docs.limit(20)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert set(table.columns) <= set(out.columns) and out.count() <= 3 * table.count()


def test_run_works_out_each_stage_once(spark, sf_dir, tmp_path):
    """The rows of run() are those of the stages written one by one, and nothing but the last stage is left in its plan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    out = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted(map(str, df.select("doc_id", "text_crc32", "shard", "slot").collect()))
    assert key(out) == key(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FileScan" not in plan
