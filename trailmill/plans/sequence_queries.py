"""Ordered-sequence operators over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import folds as L
from ..operators import sequences as S
from .catalog import query, table


def timed(spark, sf_dir):
    """Events with their time in whole seconds."""
    return table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp("ts"))


@query(
    """WITH v AS (SELECT user_id, event_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS t, value FROM events)
SELECT p.event_id, round(arg_max(v.value, v.event_id), 4) AS value_at FROM v p LEFT JOIN v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.t <= p.t WHERE p.event_type = 'purchase' GROUP BY p.event_id"""
)
def j16_as_of_hold(spark, sf_dir):
    """The value of the last view at or before each purchase."""
    events = timed(spark, sf_dir).select("user_id", "event_id", "event_type", "t", "value")
    purchases = events.filter("event_type = 'purchase'").select("user_id", "event_id", "t")
    views = events.filter("event_type = 'view'").select("user_id", "t", "value")
    return S.as_of(purchases, views, "user_id", "t", "value").select("event_id", F.round("value_at", 4).alias("value_at"))


@query(
    """WITH v AS (SELECT user_id, event_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS t, value FROM events),
b AS (SELECT p.event_id, p.t, max(v.t) FILTER (WHERE v.t <= p.t) AS t0, min(v.t) FILTER (WHERE v.t >= p.t) AS t1, arg_max(v.value, v.t) FILTER (WHERE v.t <= p.t) AS v0, arg_min(v.value, v.t) FILTER (WHERE v.t >= p.t) AS v1
  FROM v p LEFT JOIN v ON v.user_id = p.user_id AND v.event_type = 'view' WHERE p.event_type = 'purchase' GROUP BY 1, 2)
SELECT event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * ((t - t0)::DOUBLE / (t1 - t0)) END, 3) AS value_at FROM b"""
)
def j16_as_of_linear(spark, sf_dir):
    """The value of views interpolated at each purchase, clamped at both ends."""
    events = timed(spark, sf_dir).select("user_id", "event_id", "event_type", "t", "value")
    purchases = events.filter("event_type = 'purchase'").select("user_id", "event_id", "t")
    views = events.filter("event_type = 'view'").select("user_id", "t", "value", "event_id")
    return S.as_of(purchases, views, "user_id", "t", "value", "linear", tie="event_id").select("event_id", F.round("value_at", 3).alias("value_at"))


@query(
    """WITH v AS (SELECT user_id, event_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS t, value FROM events)
SELECT p.event_id, count(v.event_id) FILTER (WHERE v.event_id IS NOT NULL) AS n, round(min(v.value), 4) AS least FROM v p LEFT JOIN v ON v.user_id = p.user_id AND v.event_type = 'click' AND abs(v.t - p.t) <= 10800 WHERE p.event_type = 'purchase' GROUP BY p.event_id"""
)
def j17_interval_join(spark, sf_dir):
    """Clicks within three hours around each purchase."""
    events = timed(spark, sf_dir)
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    clicks = events.filter("event_type = 'click'").select("user_id", "t", "value")
    near = S.near_in_time(purchases, clicks, "user_id", "t", 10800, "event_id", [F.count("*").alias("n"), F.min("value").alias("least")])
    return near.select("event_id", F.coalesce("n", F.lit(0)).alias("n"), F.round("least", 4).alias("least"))


@query(
    """WITH a AS (SELECT event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS base, event_type FROM events)
SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM a GROUP BY event_type, base"""
)
def u04_ranges(spark, sf_dir):
    """Ranges of consecutive event ids of one type."""
    return S.id_ranges(table(spark, sf_dir, "events"), ["event_type"], "event_id")


@query(
    """WITH d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE - DATE '1990-01-01' AS day FROM orders),
f AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) > 90 THEN 1 ELSE 0 END AS fresh FROM d),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT o_custkey, island::BIGINT AS island, min(day) AS first, max(day) AS last, count(*) AS n FROM i GROUP BY 1, 2"""
)
def w12_islands(spark, sf_dir):
    """Runs of order days without a hole of over 90 days."""
    days = table(spark, sf_dir, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long").alias("day")).distinct()
    return S.islands(days, ["o_custkey"], "day", gap=90).groupBy("o_custkey", "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2"""
)
def w16_value_runs(spark, sf_dir):
    """Runs of one event type for each user."""
    return S.value_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


INTERVALS = """i AS (SELECT l_suppkey, l_shipdate::DATE - DATE '1990-01-01' AS s, l_shipdate::DATE - DATE '1990-01-01' + l_linenumber::INT AS e FROM lineitem),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM i),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS no FROM m),
u AS (SELECT l_suppkey, min(s) AS s, max(e) AS e, count(*) AS parts FROM n GROUP BY l_suppkey, no)"""


def intervals(spark, sf_dir):
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", day.cast("long").alias("s"), (day + F.col("l_linenumber")).cast("long").alias("e"))


@query(f"WITH {INTERVALS} SELECT l_suppkey, s, e, parts FROM u")
def w13_merged_intervals(spark, sf_dir):
    """Unions of overlapping intervals of each supplier."""
    return S.merged_intervals(intervals(spark, sf_dir), ["l_suppkey"], "s", "e")


@query(f"WITH {INTERVALS} SELECT * FROM (SELECT l_suppkey, lag(e) OVER (PARTITION BY l_suppkey ORDER BY s) AS free_from, s AS free_to FROM u) WHERE free_from IS NOT NULL")
def w14_free_ranges(spark, sf_dir):
    """Gaps between the intervals of each supplier."""
    return S.free_ranges(intervals(spark, sf_dir), ["l_suppkey"], "s", "e")


@query(
    """SELECT event_id, round(list_aggregate(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 'median'), 4) AS smooth FROM events"""
)
def w07_moving_median(spark, sf_dir):
    """The median of seven values around each event."""
    return table(spark, sf_dir, "events").select("event_id", F.round(S.moving_median(F.col("value"), ["user_id"], ["ts", "event_id"]), 4).alias("smooth"))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth FROM events""")
def w08_moving_mean(spark, sf_dir):
    """The mean of three values around each event."""
    return table(spark, sf_dir, "events").select("event_id", F.round(S.moving_mean(F.col("value"), ["user_id"], ["ts", "event_id"]), 4).alias("smooth"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS upto FROM events""")
def w09_cumulative(spark, sf_dir):
    """Running sums."""
    over = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(over), 3).alias("upto"))


@query(
    """WITH s AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
c AS (SELECT user_id, count(step) AS steps, count(*) FILTER (WHERE step > 0) AS ups FROM s GROUP BY 1)
SELECT *, CASE WHEN steps < 3 THEN 'mixed' WHEN ups / steps >= 0.7 THEN 'same' WHEN ups / steps <= 0.3 THEN 'reversed' ELSE 'mixed' END AS direction FROM c"""
)
def w02_direction(spark, sf_dir):
    """Does each user's value mostly go up, or down?"""
    return S.direction_shares(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query(
    """SELECT event_id FROM (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE value > a AND value > b"""
)
def w29_peaks(spark, sf_dir):
    """Events above both neighbours."""
    return table(spark, sf_dir, "events").withColumn("peak", S.is_peak("value", ["user_id"], ["ts", "event_id"])).filter("peak").select("event_id")


@query(
    """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE pos % 5 = 0 OR pos = n - 1"""
)
def w21_thinned(spark, sf_dir):
    """Every fifth event of each user and the last one."""
    return S.thinned(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, t AS first, t AS last, 0 AS session FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t < least(f.last + 21600, f.first + 129600) THEN f.first ELSE e.t END, e.t, CASE WHEN e.t < least(f.last + 21600, f.first + 129600) THEN f.session ELSE f.session + 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, session::BIGINT AS session FROM f"""
)
def t09_capped_sessions(spark, sf_dir):
    """Sessions that close after six quiet hours or 36 hours in all."""
    return S.capped_sessions(timed(spark, sf_dir).select("user_id", "event_id", "t"), "user_id", "t", "event_id", 21600, 129600).select("event_id", "session")


@query("""SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def t08_tumbling(spark, sf_dir):
    """Ten-minute windows of each user."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


SERIES = """s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value AS e FROM events)"""


@query(
    f"""WITH RECURSIVE {SERIES},
f AS (SELECT user_id, k, e AS ref, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss, e AS here FROM s WHERE k = 1
  UNION ALL SELECT s.user_id, s.k, CASE WHEN abs(s.e - ref) >= 30 THEN s.e ELSE ref END, gain + CASE WHEN s.e - ref >= 30 THEN s.e - ref ELSE 0 END, loss + CASE WHEN ref - s.e >= 30 THEN ref - s.e ELSE 0 END, s.e FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS rn FROM f)
SELECT user_id, round(gain + greatest(here - ref, 0), 3) AS gain, round(loss + greatest(ref - here, 0), 3) AS loss FROM l WHERE rn = 1"""
)
def a29_gain_loss(spark, sf_dir):
    """Gain and loss of each user's values with a threshold of 30."""
    series = L.ordered_values(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    climb = L.gain_loss(F.col("values"), 30.0)
    return series.select("user_id", climb.alias("c")).select("user_id", F.round("c.gain", 3).alias("gain"), F.round("c.loss", 3).alias("loss"))


@query(
    f"""WITH RECURSIVE {SERIES},
f AS (SELECT user_id, k, e AS ref, e AS ext, 0 AS dir, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss FROM s WHERE k = 1
  UNION ALL SELECT s.user_id, s.k,
    CASE WHEN dir = 1 AND s.e <= ext AND ext - s.e >= 40 THEN ext WHEN dir = -1 AND s.e >= ext AND s.e - ext >= 40 THEN ext ELSE ref END,
    CASE WHEN dir = 0 THEN CASE WHEN abs(s.e - ref) >= 40 THEN s.e ELSE ext END WHEN dir = 1 THEN CASE WHEN s.e > ext OR ext - s.e >= 40 THEN s.e ELSE ext END ELSE CASE WHEN s.e < ext OR s.e - ext >= 40 THEN s.e ELSE ext END END,
    CASE WHEN dir = 0 THEN CASE WHEN s.e - ref >= 40 THEN 1 WHEN ref - s.e >= 40 THEN -1 ELSE 0 END WHEN dir = 1 AND s.e <= ext AND ext - s.e >= 40 THEN -1 WHEN dir = -1 AND s.e >= ext AND s.e - ext >= 40 THEN 1 ELSE dir END,
    gain + CASE WHEN dir = 1 AND s.e <= ext AND ext - s.e >= 40 THEN ext - ref ELSE 0 END,
    loss + CASE WHEN dir = -1 AND s.e >= ext AND s.e - ext >= 40 THEN ref - ext ELSE 0 END
  FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS rn FROM f)
SELECT user_id, round(gain + CASE WHEN dir = 1 THEN ext - ref ELSE 0 END, 3) AS gain, round(loss + CASE WHEN dir = -1 THEN ref - ext ELSE 0 END, 3) AS loss FROM l WHERE rn = 1"""
)
def a30_hysteresis(spark, sf_dir):
    """Gain and loss of each user's values by zig-zag hysteresis of 40."""
    series = L.ordered_values(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    climb = L.hysteresis_climb(F.col("values"), 40.0)
    return series.select("user_id", climb.alias("c")).select("user_id", F.round("c.gain", 3).alias("gain"), F.round("c.loss", 3).alias("loss"))


@query(
    f"""WITH {SERIES}, d AS (SELECT a.user_id, a.k AS k1, b.k AS k2, a.e - b.e AS drop FROM s a JOIN s b ON a.user_id = b.user_id AND b.k BETWEEN a.k + 5 AND a.k + 5)
SELECT user_id, round(max(drop), 4) AS steepest FROM d GROUP BY 1"""
)
def a31_steepest(spark, sf_dir):
    """The largest fall over five steps."""
    over = W.partitionBy("user_id").orderBy("ts", "event_id")
    fall = table(spark, sf_dir, "events").select("user_id", (F.col("value") - F.lead("value", 5).over(over)).alias("fall"))
    return fall.filter("fall is not null").groupBy("user_id").agg(F.round(F.max("fall"), 4).alias("steepest"))


@query(
    """SELECT yearweek(o_orderdate)::INT AS week, (date_trunc('week', o_orderdate))::DATE AS monday, count(*) AS n FROM orders GROUP BY 1, 2"""
)
def w22_iso_weeks(spark, sf_dir):
    """Orders by ISO week."""
    week = (F.expr("extract(yearofweek from o_orderdate)") * 100 + F.weekofyear("o_orderdate")).cast("int")
    return table(spark, sf_dir, "orders").groupBy(week.alias("week"), F.date_trunc("week", "o_orderdate").cast("date").alias("monday")).agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k > 1"""
)
def w28_repeats(spark, sf_dir):
    """Lines that repeat an earlier part and supplier."""
    k = F.row_number().over(W.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").withColumn("k", k).filter("k > 1").select("l_orderkey", "l_linenumber")
