"""Group operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as G
from .catalog import query, table


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1"""
)
def w01_best_per_group(spark, sf_dir):
    """The dearest order of each customer, the oldest of equals."""
    order = [F.desc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderkey")]
    return G.best_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    """SELECT l_partkey, list_sort(list(l_quantity))[(count(l_quantity) // 2 + 1)::INT] AS median FROM lineitem GROUP BY l_partkey"""
)
def a03_upper_median(spark, sf_dir):
    """The upper median quantity of each part."""
    return G.upper_median_of_groups(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity")


@query("""SELECT l_suppkey, round(quantile_cont(l_quantity, 0.5), 4) AS median FROM lineitem GROUP BY l_suppkey""")
def c28_true_median(spark, sf_dir):
    """The true median quantity of each supplier."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(G.true_median(F.col("l_quantity")), 4).alias("median"))


@query(
    """SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') * 2 > count(*) AS mostly_kept,
  coalesce(bool_or(l_returnflag = 'N') FILTER (WHERE l_linenumber = 1), count(*) FILTER (WHERE l_returnflag = 'N') * 2 > count(*)) AS own_or_majority
FROM lineitem GROUP BY l_orderkey"""
)
def a05_majority(spark, sf_dir):
    """Is an order mostly kept; and does its first line, or else the majority, say so?"""
    vote, mine = F.col("l_returnflag") == "N", F.col("l_linenumber") == 1
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(G.strict_majority(vote).alias("mostly_kept"), G.own_or_majority(vote, mine).alias("own_or_majority"))


@query(
    """SELECT o_custkey, o_orderpriority, n, place FROM (
  SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS place
  FROM orders GROUP BY 1, 2) WHERE place <= 2"""
)
def a06_top_categories(spark, sf_dir):
    """The two most frequent priorities of each customer."""
    return G.top_categories(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", F.asc("o_orderpriority"))


@query(
    """WITH r AS (SELECT *, event_type = 'purchase' AS confirmed, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY ts DESC, event_id) AS rn
  FROM events WHERE event_type IN ('purchase', 'view')),
l AS (SELECT *, max(ts) FILTER (WHERE confirmed) OVER (PARTITION BY user_id) AS sure FROM r WHERE rn = 1)
SELECT user_id, event_id, confirmed FROM l WHERE confirmed OR sure IS NULL OR ts > sure"""
)
def a07_shown_reports(spark, sf_dir):
    """Each user's last purchase, and the last view if it is newer."""
    events = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'view')")
    return G.shown_reports(events, ["user_id"], "ts", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "confirmed")


@query(
    """SELECT user_id, coalesce(arg_max(event_type, ts) FILTER (WHERE event_type IN ('purchase', 'error')), 'open') AS status FROM events GROUP BY user_id"""
)
def a08_status(spark, sf_dir):
    """Each user's last confirmed status, else open."""
    last = F.max_by("event_type", F.when(F.col("event_type").isin("purchase", "error"), F.col("ts")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(last, F.lit("open")).alias("status"))


@query(
    """WITH n AS (SELECT *, o_orderpriority AS name FROM orders WHERE o_orderpriority <> '3-MEDIUM'),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_orderdate, o_orderkey) AS rn FROM n)
SELECT s.o_custkey, s.name, (SELECT count(DISTINCT name) FROM n WHERE n.o_custkey = s.o_custkey) - 1 AS others FROM s WHERE rn = 1"""
)
def a09_display_name(spark, sf_dir):
    """The name of each group: one's own, else the oldest contributor's."""
    orders = table(spark, sf_dir, "orders").withColumn("vote", F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")))
    named = G.display_name(orders, "o_custkey", "vote", F.col("o_orderstatus") == "P", "o_orderdate", "o_orderkey")
    return named.select("o_custkey", "name", F.size("other_names").cast("long").alias("others"))


@query(
    """SELECT o_custkey, min(p) AS least, max(p) AS greatest, count(p) AS votes FROM (SELECT o_custkey, substr(o_orderpriority, 1, 1)::INT AS p FROM orders) GROUP BY o_custkey"""
)
def a10_vote_range(spark, sf_dir):
    """Range and number of votes."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*G.vote_range(F.substring("o_orderpriority", 1, 1).cast("int")))


@query(
    """SELECT c_custkey, greatest(max(o_orderdate), max(l.shipped)) AS last_activity FROM customer
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY c_custkey"""
)
def a11_last_activity(spark, sf_dir):
    """The latest date in several child tables of each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at"))
    dates = orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("at")).unionByName(orders.join(shipped, orders["o_orderkey"] == shipped["l_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), "at"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(dates.groupBy("c_custkey").agg(F.max("at").alias("last_activity")), "c_custkey", "left")


@query(
    """SELECT l_partkey, count(DISTINCT l_suppkey) AS contributors, min(l_shipdate) AS first_seen FROM lineitem GROUP BY l_partkey"""
)
def a12_contributors(spark, sf_dir):
    """Contributors of each part and when it was first seen."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("contributors"), F.min("l_shipdate").alias("first_seen"))


@query(
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent, max(ts) FILTER (WHERE event_type = 'error') AS last_error, count(DISTINCT event_type) AS kinds
FROM events GROUP BY user_id"""
)
def a13_digest(spark, sf_dir):
    """Conditional sums of each recipient."""
    of = lambda kind: F.col("event_type") == kind
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.count_if(of("view")).alias("views"),
            F.count_if(of("purchase")).alias("purchases"),
            F.round(F.sum(F.when(of("purchase"), F.col("value"))), 4).alias("spent"),
            F.max(F.when(of("error"), F.col("ts"))).alias("last_error"),
            F.count_distinct("event_type").alias("kinds"),
        )
    )


@query(
    """WITH f AS (SELECT o_custkey, o_orderpriority, min(struct_pack(d := o_orderdate, k := o_orderkey)) AS first, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, sum(n)::BIGINT AS events, string_agg(o_orderpriority, ',' ORDER BY first) AS senders FROM f GROUP BY o_custkey"""
)
def a14_senders(spark, sf_dir):
    """Senders in the order of their first event."""
    found = G.digest_of_senders(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey")
    return found.select("o_custkey", "events", F.concat_ws(",", "senders").alias("senders"))


@query("""SELECT user_id, count(*) AS n, arg_max(event_type, ts) AS newest FROM events GROUP BY user_id""")
def a15_newest(spark, sf_dir):
    """Count and newest kind of each user."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", "ts").alias("newest"))


@query(
    """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(quantile_cont(o_totalprice, 0.5), 2) AS median, round(quantile_cont(o_totalprice, 0.95), 2) AS p95, round(max(o_totalprice), 2) AS most
FROM orders GROUP BY o_orderstatus"""
)
def a19_latency_summary(spark, sf_dir):
    """Sum, median, 95th percentile and maximum of each phase."""
    v = F.col("o_totalprice")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderstatus")
        .agg(F.count("*").alias("n"), F.round(F.sum(v), 2).alias("total"), F.round(F.percentile(v, F.lit(0.5)), 2).alias("median"), F.round(F.percentile(v, F.lit(0.95)), 2).alias("p95"), F.round(F.max(v), 2).alias("most"))
    )


@query(
    """SELECT user_id, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS last_day FROM events GROUP BY user_id"""
)
def a20_rate_window(spark, sf_dir):
    """Events of each user in the last 24 hours."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    return events.crossJoin(F.broadcast(now)).groupBy("user_id").agg(F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 1 DAY")).alias("last_day"))


@query(
    """SELECT d.d AS discount, q.q AS quantity, count(*) FILTER (WHERE l_discount <= d.d + 1e-9 AND l_quantity >= q.q) AS n
FROM lineitem, (VALUES (0.02), (0.05), (0.08)) d(d), (VALUES (10), (25), (40)) q(q) GROUP BY 1, 2"""
)
def a22_parameter_grid(spark, sf_dir):
    """Counts under every pair of two thresholds, in one pass."""
    grid = [(d, q) for d in (0.02, 0.05, 0.08) for q in (10, 25, 40)]
    counts = [F.count_if((F.col("l_discount") <= d + 1e-9) & (F.col("l_quantity") >= q)).alias(f"c{k}") for k, (d, q) in enumerate(grid)]
    rows = F.array(*[F.struct(F.lit(d).alias("discount"), F.lit(q).alias("quantity"), F.col(f"c{k}").alias("n")) for k, (d, q) in enumerate(grid)])
    return table(spark, sf_dir, "lineitem").agg(*counts).select(F.explode(rows).alias("r")).select("r.discount", "r.quantity", "r.n")


@query("""SELECT least(9, floor(l_discount * 100 + 1e-9))::INT AS bucket, count(*) AS n FROM lineitem GROUP BY 1""")
def a23_histogram(spark, sf_dir):
    """Counts by bucket."""
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.lit(9), F.floor(F.col("l_discount") * 100 + 1e-9).cast("int")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, count(*) AS rides FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def a25_ride_counts(spark, sf_dir):
    """Orders of each customer that count."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("rides"))


@query(
    """WITH b AS (SELECT user_id, event_type, max(value) AS best, (date_trunc('month', arg_max(ts, value)))::DATE AS best_month FROM events GROUP BY 1, 2)
SELECT user_id, round(max(best), 4) AS best, round(sum(best), 4) AS total, arg_max(best_month, best) AS month FROM b GROUP BY user_id"""
)
def a27_share(spark, sf_dir):
    """Best values of each user, their sum and the month of the best one."""
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("best"), F.trunc(F.max_by("ts", "value"), "MM").alias("month"))
    return best.groupBy("user_id").agg(F.round(F.max("best"), 4).alias("best"), F.round(F.sum("best"), 4).alias("total"), F.max_by("month", "best").alias("month"))


@query(
    """WITH b AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS best FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY best DESC) AS place, count(*) OVER (PARTITION BY l_partkey) AS players FROM b)
SELECT l_suppkey, count(*) AS crowns FROM r WHERE place = 1 AND players >= 2 GROUP BY 1"""
)
def a28_kings(spark, sf_dir):
    """How often each supplier leads a part with at least two suppliers."""
    return G.king_counts(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


@query(
    """SELECT yearweek(ts)::INT AS week, event_type, count(*) AS n, string_agg(DISTINCT (user_id % 7)::VARCHAR, ',' ORDER BY (user_id % 7)::VARCHAR) AS versions, min(event_id) AS first_example
FROM events GROUP BY 1, 2"""
)
def a35_weekly_digest(spark, sf_dir):
    """Events by ISO week and type with their versions and first example."""
    week = (F.expr("extract(yearofweek from ts)") * 100 + F.weekofyear("ts")).cast("int")
    versions = F.concat_ws(",", F.sort_array(F.collect_set((F.col("user_id") % 7).cast("string"))))
    return table(spark, sf_dir, "events").groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"), versions.alias("versions"), F.min("event_id").alias("first_example"))


@query(
    """SELECT a.l_suppkey AS me, b.l_suppkey AS buddy, count(DISTINCT a.l_partkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2"""
)
def a45_shared_counts(spark, sf_dir):
    """Parts that two suppliers share: distinct pairs first, then an equi-join on the part."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return G.pairs_within(pairs, "l_partkey", "l_suppkey").groupBy(F.col("a").alias("me"), F.col("b").alias("buddy")).agg(F.count("*").alias("shared"))


@query(
    """WITH s AS (SELECT o_custkey, count(*) AS sent FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, greatest(0, 3 - coalesce(sent, 0)) AS messages_left FROM customer LEFT JOIN s ON o_custkey = c_custkey"""
)
def a54_messages_left(spark, sf_dir):
    """How many of three messages are left while a request is pending."""
    sent = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("sent"))
    left = F.greatest(F.lit(0), 3 - F.coalesce("sent", F.lit(0)))
    return table(spark, sf_dir, "customer").select("c_custkey").join(sent, "c_custkey", "left").select("c_custkey", left.cast("long").alias("messages_left"))


@query(
    """WITH mine AS (SELECT o_orderpriority, max(o_totalprice) AS run FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT m.o_orderpriority, 1 + count(*) FILTER (WHERE b.best > m.run) AS place FROM mine m JOIN (SELECT o_orderpriority, o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1, 2) b ON b.o_orderpriority = m.o_orderpriority GROUP BY 1"""
)
def a55_run_rank(spark, sf_dir):
    """The place of one run among all others' bests: how many are strictly ahead."""
    orders = table(spark, sf_dir, "orders")
    mine = orders.filter("o_orderstatus = 'P'").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("run"))
    best = orders.groupBy("o_orderpriority", "o_custkey").agg(F.max("o_totalprice").alias("best"))
    return best.join(F.broadcast(mine), "o_orderpriority").groupBy("o_orderpriority").agg((F.count_if(F.col("best") > F.col("run")) + 1).alias("place"))


@query(
    """WITH t AS (SELECT c_nationkey, o_custkey, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY total DESC) AS place, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, o_custkey) AS rn FROM t)
SELECT c_nationkey, o_custkey, total, place FROM r WHERE rn <= 3 OR o_custkey % 100 = 1"""
)
def w06_ranking_shown(spark, sf_dir):
    """The first three customers of each nation and one's own, with competition ranks."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    totals = table(spark, sf_dir, "orders").join(customer, "o_custkey").groupBy("c_nationkey", "o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return G.ranking_shown(totals, ["c_nationkey"], [F.desc("total")], [F.asc("o_custkey")], F.col("o_custkey") % 100 == 1).select("c_nationkey", "o_custkey", "total", "place")


@query(
    """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS place FROM lineitem"""
)
def w05_competition_rank(spark, sf_dir):
    """Places with ties (1, 1, 3)."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.competition_rank(["l_orderkey"], [F.desc("l_quantity")]).alias("place"))


@query(
    """WITH old AS (SELECT o_custkey, max(o_totalprice) AS air, arg_max(o_orderdate, o_totalprice) AS month, max(o_orderkey) AS longest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
new AS (SELECT o_custkey, max(o_totalprice) AS air, arg_max(o_orderdate, o_totalprice) AS month, max(o_orderkey) AS longest FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, round(greatest(o.air, n.air), 2) AS air, CASE WHEN o.air IS NULL OR n.air > o.air THEN n.month ELSE o.month END AS month,
  greatest(o.longest, n.longest) AS longest, coalesce(o.air IS NULL OR n.air > o.air OR n.longest > o.longest, false) AS changed FROM old o FULL JOIN new n ON o.o_custkey = n.o_custkey"""
)
def m10_greatest_upsert(spark, sf_dir):
    """New bests merged into old ones."""
    best = lambda status: table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.max("o_totalprice").alias("air"), F.max_by("o_orderdate", "o_totalprice").alias("month"), F.max("o_orderkey").alias("longest"))
    return G.greatest_upsert(best("F"), best("O"), ["o_custkey"], "air", "month", "longest").withColumn("air", F.round("air", 2))


@query(
    """SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn > 1 AND o_orderdate < TIMESTAMP '1996-01-01'"""
)
def j15_superseded(spark, sf_dir):
    """Old orders that a newer one of the same customer and priority replaces."""
    return G.superseded(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey", F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")


@query(
    """SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE rn = 1 OR event_type IS DISTINCT FROM before"""
)
def f19_changes(spark, sf_dir):
    """Events whose type differs from the user's one before."""
    return G.changed_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query(
    """SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS asked_at, arg_max(event_id, event_id) FILTER (WHERE event_type = 'purchase') AS answer_id FROM events GROUP BY user_id"""
)
def w27_confirmations(spark, sf_dir):
    """When each user was first asked and what came last."""
    found = G.first_and_last_events(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")
    return found.select("user_id", "asked_at", F.col("answer.event_id").alias("answer_id"))


@query(
    """SELECT p_partkey FROM (SELECT *, sum(p_size) OVER (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS upto FROM part) WHERE upto <= 5000"""
)
def o08_budget(spark, sf_dir):
    """Parts that fit a size budget, the dearest first."""
    return G.limit_by_running_sum(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], "p_size", F.lit(5000)).select("p_partkey")


@query(
    """SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END DESC NULLS LAST, lower(s_name), s_suppkey) AS place FROM supplier"""
)
def o01_sorted(spark, sf_dir):
    """Suppliers by balance, unknown ones last, then by name; places instead of an order."""
    balance = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))
    found = G.in_order_of_all(table(spark, sf_dir, "supplier"), [balance.desc_nulls_last(), F.lower("s_name").asc(), F.asc("s_suppkey")])
    return found.select("s_suppkey", F.col("__place").alias("place"))
