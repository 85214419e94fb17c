import pytest

#: One row for each awkward case: equal rows, null in any column, empty, blank, letterless and very long texts.
LONG = "the quick brown fox jumps over a lazy dog and runs away " * 20_000
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (1, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "b"),
    (None, "no id here at all", "en", None),
    (None, None, None, None),
    (3, None, "de", "a"),
    (4, "", None, "b"),
    (5, " \n\t ", "en", "b"),
    (6, "12 34 !?", "en", None),
    (7, LONG, "en", "a"),
    (8, "Größe <b>&amp; мир 世界 \x85\xa0 <|im_end|>", None, "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns that operators make or use inside, which callers may have too.
CLASHING = ["size", "slot", "score", "id", "sum", "fp", "key", "copies", "taken", "n_words", "n_hit", "kept", "removed", "lang_pred", "spans", "predicted", "media", "__rank", "__id", "__text"]


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("caller's") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("false")
