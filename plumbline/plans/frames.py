"""Queries over ordered samples: framing, runs, local statistics. Events stand for samples, ordered within a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import frames as fr
from plumbline.sources.tables import table

QUERIES, ORACLES = {}, {}
X = "WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) "


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def samples(spark, sf_dir):
    return fr.positioned(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value", "pos")


@query("first_difference", X + "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos), 6) AS diff FROM x")
def first_difference(spark, sf_dir):
    return fr.first_difference(samples(spark, sf_dir), ["user_id"], "value").select("event_id", F.round("diff", 6).alias("diff"))


@query(
    "click_local_ratio",
    X + ", e AS (SELECT *, sum(value*value) OVER w - value*value AS around, count(*) OVER w - 1 AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)) SELECT event_id, round(abs(value)/(sqrt(greatest(around,0e0)/n)+1e-9),5) AS ratio FROM e WHERE n > 0",
)
def click_local_ratio(spark, sf_dir):
    return fr.local_ratio(samples(spark, sf_dir), ["user_id"], "value", 4, 3).filter("around_n > 0").select("event_id", F.round("ratio", 5).alias("ratio"))


@query(
    "merge_hits",
    X + ", h AS (SELECT user_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) > 5, true) AS fresh FROM x WHERE value > 60), r AS (SELECT user_id, pos, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM h) SELECT user_id, run::BIGINT AS run, min(pos) AS first_pos, count(*) AS n FROM r GROUP BY ALL",
)
def merge_hits(spark, sf_dir):
    hits = samples(spark, sf_dir).filter("value > 60")
    return fr.merged(hits, ["user_id"], "pos", 5).groupBy("user_id", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


@query(
    "running_min_range",
    X + ", m AS (SELECT user_id, min(value) OVER w AS low, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT user_id, round(max(low)-min(low),6) AS spread FROM m WHERE n=20 GROUP BY 1",
)
def running_min_range(spark, sf_dir):
    return fr.running_min(samples(spark, sf_dir), ["user_id"], "value", 20).groupBy("user_id").agg(F.round(F.max("low") - F.min("low"), 6).alias("spread"))


@query(
    "run_starts",
    X + ", e AS (SELECT user_id, value > 50 AND NOT coalesce(lag(value > 50) OVER (PARTITION BY user_id ORDER BY pos), false) AS edge, value > 50 AS on_ FROM x) SELECT user_id, count(*) FILTER (edge) AS runs, count(*) FILTER (on_) AS n_on FROM e GROUP BY 1",
)
def run_starts(spark, sf_dir):
    e = fr.runs_of(samples(spark, sf_dir), ["user_id"], F.col("value") > 50)
    return e.groupBy("user_id").agg(F.count_if("starts").alias("runs"), F.count_if("on").alias("n_on"))


@query(
    "long_runs",
    X + ", e AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM x WHERE value > 40), r AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id, island) SELECT user_id, count(*) AS runs, max(n) AS longest FROM r WHERE n >= 3 GROUP BY 1",
)
def long_runs(spark, sf_dir):
    islands = fr.islands(samples(spark, sf_dir).filter("value > 40"), ["user_id"], "pos")
    return islands.groupBy("user_id", "island").agg(F.count("*").alias("n")).filter("n >= 3").groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query("framing", X + "SELECT user_id, pos//8 AS frame, round(sqrt(avg(value*value)),5) AS rms FROM x GROUP BY ALL HAVING count(*)=8")
def framing(spark, sf_dir):
    f = fr.tumbling(samples(spark, sf_dir), 8).groupBy("user_id", "frame").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 5).alias("rms"), F.count("*").alias("n"))
    return f.filter("n = 8").drop("n")


SLIDE = X + ", n AS (SELECT user_id, count(*) AS n FROM x GROUP BY 1), s AS (SELECT user_id, unnest(list_distinct(list_concat(range(0, n-16+1, 8), [n-16]))) AS start FROM n WHERE n >= 16) SELECT s.user_id, s.start, sum(round(value*100)::BIGINT)::BIGINT AS cents FROM s JOIN x ON x.user_id=s.user_id AND x.pos >= s.start AND x.pos < s.start+16 GROUP BY ALL"


@query("sliding_frames", SLIDE)
def sliding_frames(spark, sf_dir):
    return fr.sliding(samples(spark, sf_dir), ["user_id"], 16, 8).groupBy("user_id", "start").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query(
    "trim_bounds",
    X + ", f AS (SELECT user_id, pos//4 AS frame, sqrt(avg(value*value)) AS rms FROM x GROUP BY ALL HAVING count(*)=4), m AS (SELECT user_id, max(rms) AS top FROM f GROUP BY 1) SELECT user_id, min(frame) FILTER (rms >= top/4) AS first_frame, max(frame) FILTER (rms >= top/4) AS last_frame FROM f JOIN m USING (user_id) GROUP BY 1",
)
def trim_bounds(spark, sf_dir):
    return fr.trimmed(samples(spark, sf_dir), ["user_id"], "value", 4, 0.25)


@query(
    "down_crossings",
    X + ", s AS (SELECT user_id, pos, avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM x), m AS (SELECT user_id, quantile_cont(v,0.5) AS mid FROM s GROUP BY 1), c AS (SELECT user_id, v < mid-1e-9 AND lag(v) OVER (PARTITION BY user_id ORDER BY pos) >= mid+1e-9 AS down FROM s JOIN m USING (user_id)) SELECT user_id, count(*) FILTER (down) AS n FROM c GROUP BY 1",
)
def down_crossings(spark, sf_dir):
    return fr.down_crossings(samples(spark, sf_dir), ["user_id"], "value", 2)


@query(
    "slopes",
    "SELECT user_id, round(regr_slope(value, pos),6) AS slope FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) GROUP BY 1 HAVING count(*) > 2",
)
def slopes(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("user_id").agg(F.round(F.regr_slope("value", "pos"), 6).alias("slope"), F.count("*").alias("n")).filter("n > 2").drop("n")


@query(
    "session_errors",
    X + ", e AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM x WHERE value < 10) SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1 HAVING max(n) >= 2",
)
def session_errors(spark, sf_dir):
    """Consecutive failures that would stop a run."""
    i = fr.islands(samples(spark, sf_dir).filter("value < 10"), ["user_id"], "pos").groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return i.groupBy("user_id").agg(F.max("n").alias("longest")).filter("longest >= 2")
