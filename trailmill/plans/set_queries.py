"""Set, visibility and inventory operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import setops as S
from ..operators import visibility as V
from .catalog import query, table

FRIENDS = """e AS (SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_custkey = a.c_custkey + a.c_nationkey + 1),
f AS (SELECT x AS me, y AS friend FROM e UNION SELECT y, x FROM e)"""


def friend_edges(spark, sf_dir):
    """Edges between customers of a nation a fixed step apart."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("requester"), F.col("c_nationkey").alias("n"), (F.col("c_custkey") + F.col("c_nationkey") + 1).alias("addressee"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("addressee"), F.col("c_nationkey").alias("n"))
    return a.join(b, ["addressee", "n"]).select("requester", "addressee", F.lit("accepted").alias("status"))


@query(
    f"""WITH {FRIENDS}, p AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT v.viewer, o_orderkey FROM (VALUES (1), (77), (500), (901)) v(viewer), orders
WHERE o_custkey = viewer OR (EXISTS (SELECT 1 FROM f WHERE me = viewer AND friend = o_custkey) AND o_custkey NOT IN (SELECT c_custkey FROM p))"""
)
def f01_visible(spark, sf_dir):
    """Orders that some viewers see: their own, and those of friends who do not keep them private."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    private = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner"))
    viewers = spark.createDataFrame([(1,), (77,), (500,), (901,)], "viewer long")
    return V.visible_to(viewers, orders, friend_edges(spark, sf_dir), private).select(F.col("viewer").cast("int").alias("viewer"), "o_orderkey")


@query(f"WITH {FRIENDS} SELECT me, count(DISTINCT friend) AS friends FROM f GROUP BY 1")
def u01_symmetric(spark, sf_dir):
    """Friends of each account from undirected edges."""
    return S.symmetric(friend_edges(spark, sf_dir), "requester", "addressee").groupBy(F.col("requester").alias("me")).agg(F.count("*").alias("friends"))


@query(
    """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"""
)
def j14_orphans(spark, sf_dir):
    """Customers without a row in either of two child tables."""
    orders = table(spark, sf_dir, "orders")
    return S.orphans(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", (orders.filter("o_orderstatus = 'P'"), "o_custkey"), (orders.filter("o_orderpriority = '1-URGENT'"), "o_custkey"))


@query(
    """WITH p AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS pair_low, greatest(l_partkey, l_suppkey) AS pair_high FROM lineitem WHERE l_returnflag = 'R'),
v AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS pair_low, greatest(l_partkey, l_suppkey) AS pair_high FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 20)
SELECT * FROM p EXCEPT SELECT * FROM v"""
)
def j13_pairs(spark, sf_dir):
    """Unordered pairs that were returned and not vetoed."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.filter("l_returnflag = 'R'").select(*S.pair_key("l_partkey", "l_suppkey")).distinct()
    return S.without_pairs(pairs, lines.filter("l_returnflag = 'A' and l_quantity > 20").select(*S.pair_key("l_partkey", "l_suppkey")))


@query(
    """SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05)"""
)
def j40_missing(spark, sf_dir):
    """Wanted parts that are published and not stored."""
    lines = table(spark, sf_dir, "lineitem")
    return S.wanted_but_missing(lines.filter("l_quantity > 45"), table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), lines.filter("l_returnflag = 'R' and l_discount > 0.05").select("l_partkey"), "l_partkey")


@query(
    """WITH a AS (SELECT o_custkey, count(*) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.v, 0) AS old, coalesce(b.v, 0) AS new, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.o_custkey = b.o_custkey"""
)
def a39_compared(spark, sf_dir):
    """Customers' order counts of two years side by side."""
    of = lambda year: table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.count("*").alias("v"))
    return S.compared(of(1996), of(1997), ["o_custkey"], "v").fillna(0, ["old", "new"])


@query(
    """WITH b AS (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN max(y) FILTER (WHERE y <= 1996 + substr(o_orderpriority, 1, 1)::INT % 3) OVER (PARTITION BY o_orderpriority) END AS cur FROM b),
d AS (SELECT *, max(y) FILTER (WHERE y < cur) OVER (PARTITION BY o_orderpriority) AS prev FROM c)
SELECT o_orderpriority, y, n, CASE WHEN cur IS NULL THEN 'unnamed' WHEN y = cur THEN 'current' WHEN y > cur THEN 'orphan' WHEN y = prev THEN 'previous' ELSE 'stale' END AS state FROM d"""
)
def a38_build_states(spark, sf_dir):
    """Which yearly builds are current, previous, orphaned or stale."""
    from pyspark.sql import Window as W

    builds = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    limit = 1996 + F.substring("o_orderpriority", 1, 1).cast("int") % 3
    latest = F.max(F.when(F.col("y") <= limit, F.col("y"))).over(W.partitionBy("o_orderpriority"))
    named = builds.withColumn("is_current", (F.col("y") == latest) & (F.col("o_orderpriority") != "5-LOW"))
    return S.build_states(named, "o_orderpriority", "y", F.col("is_current")).select("o_orderpriority", "y", "n", "state")


@query("""SELECT l_partkey, l_quantity, count(*) AS n, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS units FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def j37_duplicates(spark, sf_dir):
    """Keys that occur more than once."""
    return S.duplicates(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_quantity"], "l_returnflag").withColumn("units", F.concat_ws("", "units"))


@query(
    """SELECT 'customers' AS label, count(*) AS n FROM customer UNION ALL SELECT 'pending', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'"""
)
def a17_counters(spark, sf_dir):
    """Labelled counters of several tables."""
    n = lambda name, where="true": table(spark, sf_dir, name).filter(where).agg(F.count("*"))
    return S.label_counts(customers=n("customer"), pending=n("orders", "o_orderstatus = 'P'"), errors=n("events", "event_type = 'error'"))


@query(
    """SELECT coalesce(o_orderkey, -1) AS note, coalesce(l_orderkey, -1) AS report, coalesce(o_orderkey, l_orderkey) AS id FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey"""
)
def j08_entries(spark, sf_dir):
    """Notes beside their reports; both sides keep what has no partner."""
    notes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey")
    reports = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey").distinct()
    return notes.join(reports, notes["o_orderkey"] == reports["l_orderkey"], "full_outer").select(F.coalesce("o_orderkey", F.lit(-1)).alias("note"), F.coalesce("l_orderkey", F.lit(-1)).alias("report"), F.coalesce("o_orderkey", "l_orderkey").alias("id"))


@query(
    """SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'"""
)
def j07_names(spark, sf_dir):
    """Orders with the names that belong to them."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").join(customer, "o_custkey", "left").join(table(spark, sf_dir, "nation"), "n_nationkey", "left").select("o_orderkey", "c_name", "n_name")


@query(
    f"""WITH {FRIENDS} SELECT a.user_id AS author, f.friend AS recipient, count(*) AS events, min(a.event_id) AS first FROM events a JOIN f ON f.me = a.user_id WHERE a.event_type = 'purchase' GROUP BY 1, 2"""
)
def j06_recipients(spark, sf_dir):
    """Who hears of each author's events: friends of the author."""
    friends = S.symmetric(friend_edges(spark, sf_dir), "requester", "addressee").toDF("author", "recipient")
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("author"), "event_id")
    return events.join(friends, "author").groupBy("author", "recipient").agg(F.count("*").alias("events"), F.min("event_id").alias("first"))


@query("""SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def u07_merged_log(spark, sf_dir):
    """Two event logs merged, one row for each kind and user."""
    events = table(spark, sf_dir, "events")
    both = events.filter("event_id % 2 = 0").unionByName(events.filter("event_id % 3 > 0")).unionByName(events.filter("event_id % 6 = 3"))
    return S.first_per_key(both, ["event_type", "user_id"], [F.asc("event_id")]).select("event_type", "user_id", "event_id")


@query(
    """SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_done, bool_or(o_orderstatus = 'P') AS any_pending, count(*) FILTER (WHERE o_totalprice > 200000) AS dear FROM orders GROUP BY 1"""
)
def f07_flags(spark, sf_dir):
    """All and any flags of each group."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), F.count_if(F.col("o_totalprice") > 200000).alias("dear"))


@query(
    """SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 30 AND p_type <> 'PROMO' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.05) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"""
)
def f08_facets(spark, sf_dir):
    """Parts that pass several facet filters at once."""
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").filter("p_size between 5 and 30 and p_type <> 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    kept = part.join(lines.filter("l_discount >= 0.05"), "l_partkey", "left_semi").join(lines.filter("l_returnflag = 'R' and l_quantity > 45"), "l_partkey", "left_anti")
    return kept.select(F.col("l_partkey").alias("p_partkey"))
