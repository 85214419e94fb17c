"""Plans of what is done to training recordings, drawn from a hash of seed, epoch and row; labels and sources are not read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import jitter
from plumbline.operators.draws import numbered

#: Bounds of noise in dB, choices of a low pass in Hz, bounds of an echo in seconds and of a gain in dB. Fixed values.
SNR_DB, CUTOFFS_HZ, RT60_S, GAIN_DB = (5.0, 30.0), (3400.0, 4000.0), (0.2, 0.8), (-12.0, 12.0)
#: Odds that a row is changed, that it has one change and not two, that a random filter comes on top. Fixed values.
CHANGED, SINGLE, FILTERED = 0.65, 0.6, 0.25
#: Weights of changes in a draw; the filter is drawn by itself. Fixed values.
WEIGHTS = {"noise": 1.0, "band": 2.0, "reverb": 1.0, "gain_clip": 1.0, "codec": 1.0}
FILTER = "rawboost_conv"
#: The changes that held-out rows take in turn.
CYCLE = ("noise", "band", "reverb", "gain_clip", FILTER)
PLAN = "array<struct<op:string,value:double>>"


def parameter(op: str, u: Column) -> Column:
    """A change's parameter from a number from 0 to below 1; 0 for one that has none."""
    if op == "band":
        return F.get(F.lit(list(CUTOFFS_HZ)), F.floor(u * len(CUTOFFS_HZ)).cast("int"))
    bounds = {"noise": SNR_DB, "reverb": RT60_S, "gain_clip": GAIN_DB}.get(op)
    return F.lit(0.0) if bounds is None else bounds[0] + (bounds[1] - bounds[0]) * u


def planned(rows: DataFrame, row: str, seed: int = 0, epoch: int = 0, coded: Column | None = None, name: str = "plan") -> DataFrame:
    """`rows` plus `name`: the changes of each row in this epoch, an array of (op, value); most rows have one or none.

    Changes are drawn without repeating one, each as likely as its weight among those that are left: every change
    gets a waiting time, exponential at the rate of its weight, and the first ones to come are taken. Only rows that
    are `coded`, that is have a coded variant, can be given it. All numbers come from (seed, epoch, `row`), so a plan
    is the same in any order and on any machine. A row whose number is null is not changed.
    """

    def u(what: str) -> Column:
        return jitter(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(row).cast("string"), F.lit(f":{what}")))

    times = []
    for op, weight in WEIGHTS.items():
        one = F.struct((-F.log(1 - u(op)) / weight).alias("time"), F.lit(op).alias("op"), parameter(op, u(f"{op}:value")).alias("value"))
        times.append(one if op != "codec" or coded is None else F.when(coded, one))
    first = F.slice(F.array_sort(F.array_compact(F.array(*times))), 1, F.when(u("many") < SINGLE, 1).otherwise(2))
    drawn = F.transform(first, lambda c: F.struct(c.op.alias("op"), c.value.alias("value")))
    none = F.array().cast(PLAN)
    extra = F.when(u("filter") < FILTERED, F.array(F.struct(F.lit(FILTER).alias("op"), F.lit(0.0).alias("value")))).otherwise(none)
    return rows.withColumn(name, F.when(u("any") < CHANGED, F.concat(drawn, extra)).otherwise(none))


def cycled(rows: DataFrame, order: str, seed: int = 0) -> DataFrame:
    """`rows` plus row, op and value: one change for each row, taken in turn in the order of a distinct number.

    The same rows are changed in the same way for every model, and each change has its share of rows to be read out.
    """
    d = numbered(rows, order)
    u = jitter(F.concat(F.lit(f"{seed}:"), F.col("row").cast("string")))
    turn = F.col("row") % len(CYCLE)
    value = F.coalesce(*[F.when(turn == i, parameter(op, u)) for i, op in enumerate(CYCLE)])
    return d.withColumns({"op": F.get(F.lit(list(CYCLE)), turn.cast("int")), "value": value})


def tally(rows: DataFrame, keys: list[str], plan: str = "plan") -> DataFrame:
    """(keys, op, n, rate): how often each change was planned, and 'clean' for rows without one, among rows of the keys.

    Counts of plans are made where rows are; keys can be null.
    """
    ops = F.transform(plan, lambda c: c.op)
    named = F.when(F.size(plan) > 0, ops).otherwise(F.array(F.lit("clean")))
    plans = rows.select(*keys, named.alias("_ops")).groupBy(*keys, "_ops").agg(F.count("*").alias("_n"))
    counts = plans.select(*keys, F.explode("_ops").alias("op"), "_n").groupBy(*keys, "op").agg(F.sum("_n").alias("n"))
    c, t = counts.alias("c"), plans.groupBy(*keys).agg(F.sum("_n").alias("_all")).alias("t")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}"))
    return c.join(t, same).select("c.*", (F.col("c.n") / F.col("t._all")).alias("rate"))


def independence(rows: DataFrame, label: str, plan: str = "plan") -> DataFrame:
    """(op, rate_0, rate_1, gap, bound, skewed): whether changes fall on one label more than chance allows.

    gap is that between the shares of rows of each label, bound four of its standard errors; a label without rows
    leaves all of them null, and that is not skewed.
    """
    t = tally(rows.filter(F.col(label).isin(0, 1)), [label], plan)
    sizes = rows.agg(F.count_if(F.col(label) == 0).alias("n_0"), F.count_if(F.col(label) == 1).alias("n_1"))
    # Rows of one label that a change never fell on have no count of their own: their share is 0.
    own = lambda v: F.coalesce(F.max(F.when(F.col(label) == v, F.col("n"))), F.lit(0))
    d = t.groupBy("op").agg(own(0).alias("a"), own(1).alias("b")).join(F.broadcast(sizes))  # one row
    a, b = F.expr("a / nullif(n_0, 0)"), F.expr("b / nullif(n_1, 0)")
    pooled = F.expr("(a + b) / (n_0 + n_1)")
    error = F.sqrt(pooled * (1 - pooled) * F.expr("1 / nullif(n_0, 0) + 1 / nullif(n_1, 0)"))
    d = d.select("op", a.alias("rate_0"), b.alias("rate_1"), (a - b).alias("gap"), (4 * error).alias("bound"))
    return d.withColumn("skewed", F.coalesce(F.abs("gap") > F.col("bound") + math.ulp(1.0), F.lit(False)))
