"""Data expectations: each returns what is wrong, as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import finite

FOLDS = ("0", "1", "2", "3", "4", "holdout", "test")


def problems(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(problem, n) from aggregate expressions, in one pass."""
    wide = rows.agg(*[c.cast("long").alias(f"p{i}") for i, c in enumerate(named.values())])
    pairs = F.array(*[F.struct(F.lit(k).alias("problem"), F.col(f"p{i}").alias("n")) for i, k in enumerate(named)])
    return wide.select(F.explode(pairs).alias("p")).select("p.problem", "p.n")


def submission(rows: DataFrame, key: str, score: str, low: float, high: float) -> DataFrame:
    s = F.col(score)
    return problems(rows, {"duplicate": F.count("*") - F.count_distinct(key), "not finite": F.count_if(~finite(s)), "out of range": F.count_if(~s.between(low, high))})


def export(ev: DataFrame) -> DataFrame:
    own = problems(ev, {"fold not text": F.count_if(~F.col("fold").isin(*FOLDS)), "no label": F.count_if(F.col("y").isNull() & (F.col("split") != "test"))})
    spread = ev.filter("split = 'inner_oof'").groupBy("speaker").agg(F.count_distinct("fold").alias("k")).filter("k > 1")
    return own.unionByName(spread.agg(F.count("*").alias("n")).select(F.lit("group straddles").alias("problem"), "n"))


def cohort(rows: DataFrame, keys: list[str], want: DataFrame) -> DataFrame:
    """(keys, want, have): counts against the wanted ones, groups of either side."""
    have = rows.groupBy(*keys).agg(F.count("*").alias("have"))
    return have.join(want, keys, "full").select(*keys, F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("have", F.lit(0)).alias("have"))


def sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): whether a value is in the left set, the right one or both."""
    both = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.select(key, F.when(F.expr("l = 1 and r = 1"), "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def compared(want: DataFrame, have: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): same, differs, missing or extra; a null value never matches."""
    j = want.select(key, F.col(value).alias("_w")).join(have.select(key, F.col(value).alias("_h")), key, "full")
    status = F.when(F.col("_w").isNull(), "extra").when(F.col("_h").isNull(), "missing").when(F.col("_w") == F.col("_h"), "same").otherwise("differs")
    return j.select(key, status.alias("status"))


def twin_set(wanted: DataFrame, stored: DataFrame, twin: DataFrame, row: str, vector: str) -> DataFrame:
    """(row, problem, element): what is wrong with a stored set of vectors, against its manifest and a twin set.

    missing: wanted and not stored; extra: stored and not wanted; repeated: stored more than once; not finite: its
    first null, NaN or infinite element; twin missing; width: the twin's is another; differs: the first element that
    is not equal to the twin's, two NaN being equal. A row has the first of these that holds; element is null where
    none is meant. Rows without a number are extra. One shuffle brings the three sets together.
    """
    x = F.col(vector).cast("array<double>")
    side = lambda d, kind, v: d.select(F.col(row).alias("row"), F.lit(kind).alias("kind"), v.alias("x"))
    none = F.lit(None).cast("array<double>")
    both = side(wanted, 0, none).unionByName(side(stored, 1, x)).unionByName(side(twin, 2, x))
    count = lambda k: F.count_if(F.col("kind") == k)
    of = lambda k: F.min(F.when(F.col("kind") == k, F.col("x")))
    g = both.groupBy("row").agg(count(0).alias("wanted"), count(1).alias("n"), count(2).alias("twins"), of(1).alias("x"), of(2).alias("t"))
    first = lambda flags: F.nullif(F.coalesce(F.array_position(flags, True), F.lit(0)), F.lit(0)) - 1
    odd = first(F.transform("x", lambda v: F.coalesce(~finite(v), F.lit(True))))
    apart = first(F.zip_with("x", "t", lambda a, b: ~a.eqNullSafe(b)))
    g = g.withColumns({"odd": odd, "apart": apart})
    problem = (
        F.when(F.col("row").isNull() | (F.col("wanted") == 0) & (F.col("n") > 0), "extra").when(F.col("n") == 0, F.when(F.col("wanted") > 0, "missing")).when(F.col("n") > 1, "repeated")
        .when(F.col("x").isNull(), "not finite").when(F.col("odd").isNotNull(), "not finite").when(F.col("t").isNull(), "twin missing")
        .when(F.size("x") != F.size("t"), "width").when(F.col("apart").isNotNull(), "differs")
    )
    element = F.when(F.col("problem") == "not finite", F.col("odd")).when(F.col("problem") == "differs", F.col("apart"))
    return g.withColumn("problem", problem).filter("problem is not null").select("row", "problem", element.cast("int").alias("element"))


def all_of(*parts: DataFrame) -> DataFrame:
    """Violations of several checks together; empty if all hold."""
    return reduce(DataFrame.unionByName, parts).filter("n > 0")


def constants_problem(text: Column, names: tuple[str, ...]) -> Column:
    """What is wrong with a JSON document of fusion constants; empty if nothing, the first in this order otherwise.

    not json, not an object; alpha or weights: one of them has to be there; alpha: a share; weights: positive numbers
    that make one; unknown name; reference: ascending numbers for each weighted name (with alpha, the first two names);
    platt: a, b and prior_shift; suppression: three numbers where it is applied. Texts and booleans are no numbers.
    """
    v = F.try_parse_json(text)
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    kind = lambda path: F.coalesce(F.schema_of_variant(at(path, "variant")), F.lit("VOID"))
    numeric = lambda shown: shown.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$")
    numbers = lambda path, keys: reduce(lambda a, b: a & b, [numeric(kind(f"{path}.{k}")) for k in keys])
    is_number = lambda x: F.coalesce(numeric(F.schema_of_variant(x)), F.lit(False))
    double = lambda x: F.try_variant_get(x, "$", "double")

    alpha, weighted = kind("$.alpha") != "VOID", kind("$.weights") != "VOID"
    share = numeric(kind("$.alpha")) & at("$.alpha", "double").between(0.0, 1.0)
    weights = at("$.weights", "map<string,variant>")
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + double(x))
    positive = F.forall(F.map_values(weights), lambda x: is_number(x) & (double(x) > 0))
    sound = weights.isNotNull() & (F.size(weights) > 0) & positive & (F.abs(total - 1.0) <= 1e-9)
    used = F.when(weighted, F.map_keys(weights)).otherwise(F.array(*[F.lit(n) for n in names[:2]]))
    known = F.forall(used, lambda k: k.isin(*names))
    references = at("$.references", "map<string,array<variant>>")

    def ascending(name: Column) -> Column:
        x = F.try_element_at(references, name)
        values = F.transform(x, double)
        return F.coalesce((F.size(x) > 0) & F.forall(x, is_number) & (F.array_sort(values) == values), F.lit(False))

    no = lambda c: ~F.coalesce(c, F.lit(False))
    found = [
        ("not json", v.isNull()),
        ("not an object", no(kind("$").startswith("OBJECT"))),
        ("alpha or weights", alpha == weighted),
        ("alpha", ~weighted & no(share)),
        ("weights", weighted & no(sound)),
        ("unknown name", no(known)),
        ("reference", no(F.forall(used, ascending))),
        ("platt", no(numbers("$.platt", ("a", "b", "prior_shift")))),
        ("suppression", F.coalesce(at("$.suppression.applied", "boolean"), F.lit(False)) & no(numbers("$.suppression", ("logit_below", "rank_above", "multiply_by")))),
    ]
    return F.coalesce(*[F.when(wrong, problem) for problem, wrong in found], F.lit(""))


def document_problem(spark: SparkSession, text: str | None, names: tuple[str, ...]) -> str:
    """constants_problem of one document."""
    return spark.createDataFrame([(text,)], "t string").select(constants_problem(F.col("t"), names)).first()[0]
