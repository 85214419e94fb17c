"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. A document's expected copies are its weight times a factor of its source,
at most `most`; the factors are set so that expected words meet the targets. The whole part is allocated for
certain. The rest is an inclusion probability p, and documents are ranked by the random odds u / (1 - u) divided by
the inclusion odds p / (1 - p); the lowest ranks are taken until the source's remaining words are met.

The cut of each source is found without sorting it: two rounds of 4096 rank bins (partial sums on the map side)
leave about one row in 16 million, grouped by rank, for a window. Applying the cut is a comparison on each row. Only
where equal rows stand at a cut are these rows numbered, in groups of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, free_name, word_count

BINS = 4096
#: Tables of at most so many sources are broadcast to the rows and ordered in one task; larger ones are joined by
#: shuffling both sides and ordered in ranges.
FEW_SOURCES = 100_000
#: Equal rows at a cut are numbered in groups of about so many.
NUMBERED = 1 << 20
#: Steps of an octave to which weights of the caller are rounded.
STEPS = 8


def _ordered(df: DataFrame, order: list[Column], sums: list[str], few: bool) -> DataFrame:
    """`df` plus turn (1 for the first) and, for each of `sums`, before_<name>: its sum over rows ahead in `order`."""
    if few:
        by = Window.orderBy(*order)
        return df.withColumns({"turn": F.row_number().over(by).cast("long")} | {f"before_{c}": F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)) for c in sums}).fillna(0, [f"before_{c}" for c in sums])
    ranged = checkpointed(df.repartitionByRange(256, *order).withColumn("range", F.spark_partition_id()))
    heads = ranged.groupBy("range").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in sums])
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"h_{c}") for c in ["n", *[f"s_{c}" for c in sums]]])
    inside = Window.partitionBy("range").orderBy(*order)
    both = ranged.join(F.broadcast(heads), "range")  # 256 rows
    out = both.withColumns({"turn": F.col("h_n") + F.row_number().over(inside)} | {f"before_{c}": F.col(f"h_s_{c}") + F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums})
    return out.select(*df.columns, "turn", *[f"before_{c}" for c in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """From checkpointed (source, source_size): target as double.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target
    stops at `most` times the source's size; what is above goes to the others by weight. With sources ordered by
    size over weight those that stop are a prefix, so running sums give the final share for a unit of weight.
    """
    few = sizes.count() <= FEW_SOURCES
    w = _ordered(sizes, [F.col("source").isNull(), F.col("source")], [], few).withColumnRenamed("turn", "place")
    w = w.withColumn("weight", F.get(F.lit([float(x) for x in weights]), ((F.col("place") - 1) % len(weights)).cast("int")))
    w = checkpointed(w.withColumn("cap", F.col("source_size") * most))
    words, pull = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    w = _ordered(w, [F.col("source_size") / F.col("weight"), F.col("place")], ["cap", "weight"], few)
    unit = (F.lit(words) - F.col("before_cap")).cast("double") / (F.lit(pull) - F.col("before_weight"))
    w = checkpointed(w.withColumn("unit", unit))
    first = w.filter(~(F.col("cap") < F.col("unit") * F.col("weight"))).agg(F.min(F.struct("turn", "unit")).alias("first")).first()["first"]
    share = F.lit(first["unit"] if first else 0.0)
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), share * F.col("weight")).alias("target"))


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A draw in (0, 1) from id and text: 52 bits of an MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def bit_length(size: Column) -> Column:
    """Binary digits of a size: the weight of longer texts grows with the logarithm of their words."""
    return F.length(F.bin(size)).cast("double")


def rounded(weight: Column) -> Column:
    """A weight rounded down to a step of an octave, so that a source has few different ones; null or negative: 0."""
    return F.when(weight > 0, F.pow(F.lit(2.0), F.floor(F.log2(weight) * STEPS) / STEPS)).otherwise(F.lit(0.0))


def _few(sources: DataFrame) -> DataFrame:
    """A checkpointed table of a row for each source, marked for broadcast if its rows are counted to be few."""
    return F.broadcast(sources) if sources.count() <= FEW_SOURCES else sources


def _factors(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target, factor): expected copies of a row are least(most, factor * weight).

    Weights from the heaviest down reach `most`; the others share what the target leaves in proportion to weight.
    """
    kinds = checkpointed(rows.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    totals = checkpointed(kinds.groupBy("source").agg(F.sum("words").alias("source_size")))
    targets = checkpointed(source_targets(totals, weights, most))
    down = Window.partitionBy("k.source").orderBy(F.col("weight").desc())
    k = kinds.alias("k").join(targets.alias("t"), F.col("k.source").eqNullSafe(F.col("t.source"))).select("k.*", "t.target", F.sum("words").over(down).alias("upto"), F.sum(F.col("weight") * F.col("words")).over(down).alias("w_upto"), F.sum(F.col("weight") * F.col("words")).over(Window.partitionBy("k.source")).alias("w_all"))
    heavier, left = F.col("upto") - F.col("words"), F.col("w_all") - F.col("w_upto") + F.col("weight") * F.col("words")
    factor = F.when(left > 0, (F.col("target") - most * heavier) / left)
    fits = k.select("source", "weight", factor.alias("factor")).filter(F.col("factor") * F.col("weight") < most)
    fits = fits.groupBy("source").agg(F.max_by("factor", "weight").alias("factor"))
    with_factor = targets.alias("t").join(fits.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left")
    return checkpointed(with_factor.select("t.source", "t.source_size", "t.target", "f.factor"))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row for each source: its sizes, target, factor, and where its sample ends.

    rows: (id, source, size, draw, weight). end: the last key (y, draw, size, id) of which rows are taken; some: how
    many of the `tied` rows of that key.
    """
    sources = _factors(rows, weights, most)
    joined = rows.alias("r").join(_few(sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    ranked = joined.select("r.id", "s.source", "r.size", "r.draw", "s.target", *_shares(F.col("r.size"), F.col("r.draw"), F.col("r.weight"), "s", most))
    whole = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    open_ = ranked.filter("y < 1 and size > 0")
    need = whole
    for k in range(2):
        code = F.floor(F.col("y") * float(BINS ** (k + 1))).cast("long")
        sums = open_.withColumn("bin", code).groupBy("source", "bin").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bin"))
        sums = sums.withColumn("end", upto).alias("b").join(need.select("source", "need").alias("w"), F.col("b.source").eqNullSafe(F.col("w.source")))
        cut = sums.filter("end - b.n <= need and need < end").select("b.source", "bin", (F.col("need") - F.col("end") + F.col("b.n")).alias("need"))
        need = checkpointed(cut)
        open_ = open_.alias("r").join(_few(need).alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (code == F.col("c.bin")), "left_semi")
    keys = open_.groupBy("source", "y", "draw", "size", "id").agg(F.count("*").alias("tied"))
    last = Window.partitionBy("r.source").orderBy("y", "draw", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("tied")).over(last), F.lit(0))
    tail = keys.alias("r").join(_few(need).alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.source", F.struct("y", "draw", "size", "id").alias("end"), "size", "tied", (F.col("need") - before).alias("room"))
    some = F.least(F.col("tied"), F.floor((F.col("room") - F.col("size") / 2.0) / F.col("size")).cast("long") + 1)
    ends = tail.filter("size / 2.0D <= room").groupBy("source").agg(F.max(F.struct("end", "tied", some.alias("some"))).alias("at"))
    # A source without a cut takes all of its rows; one whose first row in the cut bin is too much ends below that bin.
    plan = sources.alias("s").join(need.alias("d"), F.col("s.source").eqNullSafe(F.col("d.source")), "left").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    below = F.coalesce(F.col("d.bin") / float(BINS**2), F.lit(2.0))
    return checkpointed(plan.select("s.*", below.alias("below"), F.col("e.at.end").alias("end"), F.col("e.at.tied").alias("tied"), F.col("e.at.some").alias("some")))


def _shares(size: Column, draw: Column, weight: Column, s: str, most: int) -> list[Column]:
    """whole: certain copies; y: the Pareto rank mapped to [0, 1], 1 for rows that may take no further copy.

    A source without a factor has a target of `most` copies of everything.
    """
    factor = F.col(f"{s}.factor")
    expected = F.when((size <= 0) | (weight <= 0), F.lit(0.0)).when(factor.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), factor * weight))
    whole = F.floor(expected)
    p = expected - whole
    rank = (draw / (1.0 - draw)) / (p / (1.0 - p))
    y = F.when((p <= 0) | (whole >= most), F.lit(1.0)).otherwise(F.least(rank / (1.0 + rank), F.lit(1 - 2.0**-40)))
    return [whole.alias("whole"), y.alias("y")]


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 11) -> DataFrame:
    """All rows and columns of `docs` plus size, source_size, target, copies, taken.

    size: words of the text (null: 0). copies: how often the mix takes the row, 0 to `most`; taken: copies * size.
    weight_col: relative weight of a row inside its source (null or negative: 0, never taken), rounded down to an
    eighth of an octave; None: the number of binary digits of the row's size, so that a text of 1,000 words is twice
    as likely as one of 31. A null source is a source, the last one. Draws come from id and text, so null and
    repeated ids have draws of their own; rows equal in both are alike, and as many of them are taken as the target
    asks for (which ones of several groups of NUMBERED equal rows rounds up by a row at most). Empty texts take
    nothing. An empty table gives an empty result. Columns of `docs` named like an output column are replaced.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*(c for c in made if c in docs.columns and c not in (id_col, text_col, source_col, weight_col)))
    size = word_count(F.col(text_col))
    weight = bit_length(size) if weight_col is None else rounded(F.col(weight_col).cast("double"))
    parts = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), uniform(F.col(id_col), F.col(text_col), seed).alias("draw")]
    slim = docs.select(*parts, *([weight.alias("weight")] if weight_col is not None else []))
    slim = checkpointed(slim if weight_col is not None else slim.withColumn("weight", bit_length(F.col("size"))))
    plan = _plan(slim, weights, most)
    if set(docs.columns) == {id_col, text_col, source_col}:
        return _applied(slim, plan, "source", [F.col("r.id").alias(id_col), F.col("r.source").alias(source_col)], most)
    size, draw, wt, ident = (free_name(docs, k) for k in ("size", "draw", "weight", "id"))
    rows = docs.withColumns({ident: parts[0], size: parts[2], draw: parts[3]})
    rows = rows.withColumn(wt, weight if weight_col is not None else bit_length(F.col(size)))
    return _applied(rows, plan, source_col, [F.col(f"r.`{c}`") for c in docs.columns], most, ident, size, draw, wt)


def _applied(rows: DataFrame, plan: DataFrame, source_col: str, keep: list[Column], most: int, ident: str = "id", size: str = "size", draw: str = "draw", weight: str = "weight") -> DataFrame:
    n, u = F.col(f"r.`{size}`"), F.col(f"r.`{draw}`")
    both = rows.alias("r").join(_few(plan).alias("s"), F.col(f"r.`{source_col}`").eqNullSafe(F.col("s.source")))
    whole, y = _shares(n, u, F.col(f"r.`{weight}`"), "s", most)
    out = both.select(*keep, n.alias("size"), "s.source_size", "s.target", whole, y, F.struct(y, u.alias("draw"), n.alias("size"), F.col(f"r.`{ident}`").alias("id")).alias("at"), "s.below", "s.end", "s.tied", "s.some")
    under = (F.col("y") < 1) & ((F.col("y") < F.col("below")) | F.coalesce(F.col("at") <= F.col("end"), F.lit(False)))
    out = out.withColumn("more", under)
    if plan.filter("some < tied").count():
        split = F.coalesce((F.col("at") == F.col("end")) & (F.col("some") < F.col("tied")), F.lit(False))
        group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("tied") / NUMBERED))
        tied = out.filter(split).withColumn("group", group)
        share = F.col("some") / F.col("tied") * F.row_number().over(w := Window.partitionBy("end", "group").orderBy("tied"))
        first = F.col("some") / F.col("tied") * (F.row_number().over(w) - 1)
        out = out.filter(~split).unionAll(tied.withColumn("more", F.round(share) > F.round(first)).drop("group"))
    copies = (F.col("whole") + F.col("more").cast("int")).cast("int")
    return out.withColumns({"copies": copies, "taken": copies * F.col("size")}).drop("whole", "y", "at", "below", "end", "tied", "some", "more")


def op4(docs: DataFrame) -> DataFrame:
    """Contract columns of the mixing query, and the copies taken."""
    mixed = mix_sources(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"), "copies")
