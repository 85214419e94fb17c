"""Stratified folds of whole groups.

Groups with the same number of rows of each label are of one kind and stand for each other. Kinds are dealt in order,
the most one-sided and then the largest first, each in rounds: a whole round gives every fold one group of the kind,
and the groups of the last, partial round go one by one to the fold, not yet served in this round, where the sum of
squared class shares grows least. So only a table of kinds is ever looked at as a whole; groups are numbered inside
their kind over ranges of a hash, and a kind that most groups are of is not one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import settled
from plumbline.functions.prefix import running
from plumbline.functions.scalars import jitter

#: So many kinds are dealt on the driver at most; beyond it, counts are rounded down to fewer leading bits for the dealing.
KINDS = 200_000
#: Labels may have so many values.
CLASSES = 64


def partial_rounds(kinds: list[tuple[tuple[int, ...], int]], k: int) -> dict[tuple[int, ...], list[int]]:
    """From (rows of each class, number of groups) to the folds that each kind's last round goes to, in order."""
    width = len(kinds[0][0]) if kinds else 0
    total = [max(1, sum(n[c] * m for n, m in kinds)) for c in range(width)]
    weight = [math.prod(t * t for i, t in enumerate(total) if i != c) for c in range(width)]
    have = [[0] * width for _ in range(k)]
    out = {}
    for n, m in sorted(kinds, key=lambda x: (min(x[0]) - max(x[0]), -sum(x[0]), x[0])):
        whole, rest = divmod(m, k)
        for f in have:
            for c in range(width):
                f[c] += whole * n[c]
        free, out[n] = set(range(k)), []
        for _ in range(rest):
            at = min(free, key=lambda f: (sum(have[f][c] * n[c] * weight[c] for c in range(width)), sum(have[f]), f))  # noqa: B023
            free.remove(at)
            out[n].append(at)
            for c in range(width):
                have[at][c] += n[c]
    return out


def _rounded(counts, bits: int | None):
    """Counts as a key; with `bits`, only so many leading bits of each are kept."""
    if bits is None:
        return F.array_join(F.transform(counts, lambda n: n.cast("string")), ",")
    step = lambda n: F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(n)) - bits)).cast("long")
    return F.array_join(F.transform(counts, lambda n: (F.floor(n / step(n)) * step(n)).cast("string")), ",")


def grouped_folds(rows: DataFrame, group: str, label: str | None = None, k: int = 5, seed: int = 0) -> DataFrame:
    """(group, fold): whole groups in folds 0 to k - 1, near in rows of each label; without a label, near in rows.

    Rows without a group or, if it is asked for, without a label are left out. Groups of one kind are numbered by a
    hash of their name and the seed, then by name.
    """
    ok = rows.filter(F.col(group).isNotNull())
    if label is None:
        counts = F.array(F.count("*"))
    else:
        ok = ok.filter(F.col(label).isNotNull())
        classes = [r[0] for r in ok.select(label).distinct().limit(CLASSES + 1).collect()]
        if len(classes) > CLASSES:
            raise ValueError(f"more than {CLASSES} labels")
        counts = F.array(*[F.count_if(F.col(label) == F.lit(c)) for c in sorted(classes)] or [F.count("*")])
    draw = jitter(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))
    groups = settled(ok.groupBy(group).agg(counts.alias("_counts")).withColumns({"_draw": draw, "_one": F.lit(1)}))
    for bits in (None, 10, 7, 5, 4, 3, 2, 1):
        keyed = groups.withColumn("_kind", _rounded(F.col("_counts"), bits))
        kinds = settled(keyed.groupBy("_kind").agg(F.count("*").alias("m")))
        if kinds.count() <= KINDS:
            break
    else:
        raise ValueError(f"more than {KINDS} kinds of groups")
    table = [(tuple(map(int, r["_kind"].split(","))), r["m"]) for r in kinds.collect()]
    last = partial_rounds(table, k)
    plan = [(",".join(map(str, n)), m - m % k, last[n]) for n, m in table]
    plan = rows.sparkSession.createDataFrame(plan, "_kind string, _whole long, _last array<int>")
    numbered = running(keyed, ["_kind"], "_draw", ["_one"], ties=[group]).join(F.broadcast(plan), "_kind")  # KINDS rows at most
    place = F.col("run__one") - 1
    fold = F.when(place < F.col("_whole"), place % k).otherwise(F.get("_last", (place - F.col("_whole")).cast("int")))
    return numbered.select(group, fold.cast("int").alias("fold"))
