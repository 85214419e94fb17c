"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import audio, decontam, hilbert, html_text, langid, mixing, simhash, substrings, toxicity


def items(spark):
    return spark.createDataFrame([(1, "one two three"), (None, "quick brown fox jumps over a lazy dog and runs away"), (3, None), (4, ""), (1, "one two three")], "item_id long, text string")


def languages(docs):
    return langid.identify(docs, langid.fit(langid.labelled_sample(docs, F.lit(True))))


def toxic(docs):
    labels = docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    return toxicity.scored(docs, toxicity.fit(docs, labels, F.lit(True)))


OPERATORS = {
    "html": lambda d: html_text.main_text(d, html_col="text"),
    "toxicity": toxic,
    "mixing": lambda d: mixing.mix_sources(d),
    "passages": lambda d: substrings.without_repeats(d),
    "languages": languages,
    "shards": lambda d: hilbert.hilbert_shards(d, 4),
    "audio": lambda d: audio.media_columns(d),
    "benchmark": lambda d: decontam.decontaminated(d, items(d.sparkSession)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, name):
    out = OPERATORS[name](awkward)
    assert out.count() == awkward.count()
    assert len(set(out.columns)) == len(out.columns) and set(awkward.columns) <= set(out.columns)
    made = [c for c in out.columns if c not in awkward.columns or dict(out.dtypes)[c] != dict(awkward.dtypes)[c]]
    if name not in ("shards",):  # equal rows have equal results; only shards number them
        rows = [tuple(map(str, r)) for r in out.filter("doc_id = 1").select(*made).collect()]
        assert rows[0] == rows[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


def test_near_duplicates(awkward, nothing):
    got = simhash.near_duplicates(awkward)
    assert got.count() == awkward.count()
    wordless = got.filter("fp = 0").select("component_id").distinct().collect()
    assert [r[0] for r in wordless] == [3]
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each_group(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert simhash.one_of_each_group(nothing).count() == 0


def test_near_duplicates_with_one_id_on_unlike_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven eight"
    docs = spark.createDataFrame([(5, a), (5, b), (6, b), (7, a)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each_group(docs).collect())) == [(5, a), (5, b)]


def test_near_duplicates_with_repeated_ids(spark):
    """Identical rows, rows apart in another column only, and null ids: one row of each stays, chosen alike each time."""
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "y"), (2, "a b c d", "x"), (4, "u v w z", "x"), (None, "k l m n", "x"), (None, "k l m n", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = ([tuple(r) for r in simhash.one_of_each_group(d).collect()] for d in (docs, docs.orderBy(F.rand(3))))
    assert sorted((r[0] or 0, r[1]) for r in once) == [(0, "k l m n"), (1, "a b c d"), (4, "u v w z")]
    assert sorted(once, key=str) == sorted(again, key=str)


def test_many_copies_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c d" if i % 3 else f"text number {i} of many") for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    for few in (0, 4):
        monkeypatch.setattr(simhash, "FEW", few)
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_empty_benchmark(spark, awkward):
    out = decontam.decontaminated(awkward, items(spark).filter("false"))
    assert out.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_null_items_and_short_items(spark, awkward):
    out = {r["doc_id"]: r for r in decontam.decontaminated(awkward, items(spark)).collect()}
    assert out[1]["n_hit"] == 3 and out[1]["n_items"] == 1
    assert out[7]["contaminated"] and out[7]["n_hit"] > 100_000
    assert not out[6]["contaminated"] and out[3]["n_words"] == 0
