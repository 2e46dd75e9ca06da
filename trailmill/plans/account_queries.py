"""Accounts, routes and small rules over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import accounts as A
from ..operators import graphs as N
from ..operators import routes as R
from .catalog import query, table
from .set_queries import FRIENDS, friend_edges
from .spatial_queries import vectors


def orders(spark, sf_dir):
    """The orders table."""
    return table(spark, sf_dir, "orders")


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE, '%Y-%m-%d %H:%M') END AS at, isoyear(o_orderdate) || '-W' || lpad(week(o_orderdate)::VARCHAR, 2, '0') AS week, o_orderdate::DATE >= DATE '1998-08-02' - 30 AS fresh FROM orders""")
def c21_dates(spark, sf_dir):
    """Month, time from a provider's notation, ISO week and freshness by days of each order (C21 to C23)."""
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    text = F.when(F.col("o_orderkey") % 4 > 0, F.date_format(at, "MM/dd/yyyy hh:mm:ss a")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    shown = F.date_format(V.provider_time(text), "yyyy-MM-dd HH:mm")
    return orders(spark, sf_dir).select("o_orderkey", V.month_of(F.col("o_orderdate")).cast("string").alias("month"), shown.alias("at"), V.week_label(F.col("o_orderdate")).alias("week"), V.fresh_by_day(F.col("o_orderdate"), F.lit("1998-08-02").cast("timestamp")).alias("fresh"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(200, floor((l_discount * 200 + l_quantity / 8) * 10 + 0.5)))::INT AS tenths FROM lineitem""")
def c29_deciseconds(spark, sf_dir):
    """Tenths of seconds within bounds."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.deciseconds(F.col("l_discount") * 200 + F.col("l_quantity") / 8, 200).alias("tenths"))


@query(
    """WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(CASE WHEN list_contains(p, '1-URGENT') THEN p ELSE list_append(p, '1-URGENT') END, '|') AS more, len(list_filter(p, lambda x: x NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) = 0 AS common, array_to_string(CASE WHEN o_custkey % 2 = 0 THEN list_reverse(p) ELSE p END, '|') AS turned FROM a"""
)
def c33_arrays(spark, sf_dir):
    """Arrays with a value added unless it is there, tested as subsets and turned (C33, C34, U09)."""
    rows = orders(spark, sf_dir).groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("p"))
    common = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    return rows.select("o_custkey", F.array_join(V.appended(F.col("p"), F.lit("1-URGENT")), "|").alias("more"), V.subset_of(F.col("p"), common).alias("common"), F.array_join(V.turned(F.col("p"), F.col("o_custkey") % 2 == 0), "|").alias("turned"))


@query("""SELECT o_custkey, string_agg(p || '=' || n, ';' ORDER BY p) AS text, sum(n) AS total FROM (SELECT o_custkey, o_orderstatus AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def c36_counts(spark, sf_dir):
    """Counts as text, and read back with a malformed part."""
    counts = orders(spark, sf_dir).groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    rows = counts.select("o_custkey", V.counts_text(F.col("m")).alias("text"))
    back = V.counts_of(F.concat("text", F.lit(";odd;x=y")))
    return rows.select("o_custkey", "text", F.aggregate(F.map_values(back), F.lit(0).cast("long"), lambda a, n: a + n).alias("total"))


@query("""SELECT c_custkey, c_custkey % 5 > 0 AS line, CASE WHEN c_custkey % 5 > 0 THEN 2 END AS n, CASE WHEN c_custkey % 5 > 0 THEN round(c_acctbal / 100 + 1, 4) END AS north FROM customer""")
def c38_geojson(spark, sf_dir):
    """Lines as GeoJSON and back; other geometries are no line."""
    lat, lon = F.col("c_acctbal") / 100, (F.col("c_custkey") % 360).cast("double")
    text = V.line_geojson(F.array(F.struct(lon.alias("lon"), lat.alias("lat")), F.struct((lon + 1).alias("lon"), (lat + 1).alias("lat"))))
    points = V.line_of_geojson(F.when(F.col("c_custkey") % 5 > 0, text).otherwise(F.replace(text, F.lit("LineString"), F.lit("Point"))))
    rows = table(spark, sf_dir, "customer").select("c_custkey", points.alias("p"))
    return rows.select("c_custkey", F.col("p").isNotNull().alias("line"), F.when(F.col("p").isNotNull(), F.size("p")).alias("n"), F.round(F.element_at("p", -1)["lat"], 4).alias("north"))


@query("""SELECT event_id, (event_type = 'click') <> (value > 100) AS one FROM events""")
def c42_exactly_one(spark, sf_dir):
    """Is exactly one of two values missing?"""
    return table(spark, sf_dir, "events").select("event_id", V.exactly_one(F.when(F.col("event_type") == "click", 1), F.when(F.col("value") > 100, 1)).alias("one"))


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber, (['ways', 'heights', 'map', 'other', 'names', 'pois', 'manifest', 'other'])[l_partkey % 8 + 1] AS kind FROM lineitem"""
)
def f29_request_kind(spark, sf_dir):
    """What each request asks for, by its path."""
    paths = ("/a/ways-1.pmtiles", "/heights-2.pmtiles", "/x/overview-3.pmtiles", "/b/else.pmtiles", "/names/ab.json", "/p/-12_7.water.json", "/p/index.json", "/p/-12_7.water.txt")
    path = F.get(F.array(*map(F.lit, paths)), (F.col("l_partkey") % 8).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", V.request_kind(path).alias("kind"))


@query(
    """SELECT o_orderkey, CASE WHEN lim < 3000 AND w >= lim + 100 AND (dec IS NULL OR w >= dec + 100) THEN least(w, 3000) END::DOUBLE AS offered FROM (SELECT o_orderkey, floor(o_totalprice / 5000) * 100 AS w, (o_custkey % 31) * 100 AS lim, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 40) * 100 END AS dec FROM orders)"""
)
def a49_offered_limits(spark, sf_dir):
    """Limits that are offered to be raised after a ride."""
    declined = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 40) * 100)
    return orders(spark, sf_dir).select("o_orderkey", V.offered_limit(F.col("o_totalprice") / 50, (F.col("o_custkey") % 31) * 100, declined).cast("double").alias("offered"))


@query(
    """WITH p AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, range(32) t(i)), r AS (SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER v) AS px, coalesce(lag(y) OVER w, last_value(y) OVER v) AS py FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i), v AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT vec_id, (y <= 0.1)::INT + ((y <= 0.1) <> (py <= 0.1))::INT AS k, CASE WHEN y <= 0.1 THEN x ELSE 0 END + CASE WHEN (y <= 0.1) <> (py <= 0.1) THEN px + (0.1 - py) / (y - py) * (x - px) ELSE 0 END AS s FROM r)
SELECT vec_id AS line_id, sum(k)::INT AS n, round(sum(s), 6) AS sx FROM c GROUP BY 1 HAVING sum(k) >= 3"""
)
def g27_clipped(spark, sf_dir):
    """Points and their sum of rings clipped at a latitude."""
    cut = vectors(spark, sf_dir).select("line_id", V.clipped_north(F.col("points"), F.lit(0.1)).alias("c")).filter("size(c) > 0")
    return cut.select("line_id", F.size("c").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda a, p: a + p["x"]), 6).alias("sx"))


@query("""SELECT vec_id AS line_id, round(list_sum(list_transform(range(32), lambda i: embedding[2 * i + 1]::DOUBLE * (2 * i + 1) + embedding[2 * i + 2]::DOUBLE * (2 * i + 2))), 5) AS weighed, 64 AS n FROM embeddings""")
def u03_interleaved(spark, sf_dir):
    """Flat arrays of both coordinates in turn."""
    flat = V.interleaved(F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"]))
    rows = vectors(spark, sf_dir).select("line_id", flat.alias("f"))
    return rows.select("line_id", F.round(F.aggregate(F.transform("f", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v), 5).alias("weighed"), F.size("f").alias("n"))


@query("""SELECT doc_id, string_agg(w, '|' ORDER BY i DESC) AS back FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def w04_ordinality(spark, sf_dir):
    """Words with their place, gathered again the other way round."""
    words = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    rows = F.sort_array(F.collect_list(F.struct("i", "w")), asc=False)
    return words.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["w"]), "|").alias("back"))


@query(
    """WITH s AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS p FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN len(p) < 2 OR (o_custkey % 3 = 1 AND len(p) > 2) THEN -1 WHEN o_custkey % 3 = 2 THEN len(p) // 2 + CASE WHEN len(p) % 2 = 0 THEN 1 ELSE 1 END ELSE len(p) END::INT AS n FROM s"""
)
def j28_stored_in_track(spark, sf_dir):
    """How many points of a stored line were found in a raw track in order, -1 if it is not that track."""
    raw = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.struct(k.cast("double").alias("x"), (k % 5).cast("double").alias("y")))
    rows = orders(spark, sf_dir).groupBy("o_custkey").agg(raw.alias("raw"))
    n = F.size("raw")
    thinned = F.filter("raw", lambda p, k: (k % 2 == 0) & (k < n - 1) | (k == n - 1))
    moved = F.transform("raw", lambda p, k: F.struct((p["x"] + F.when(k == 1, 0.5).otherwise(0.0)).alias("x"), p["y"].alias("y")))
    stored = F.when(F.col("o_custkey") % 3 == 2, thinned).when((F.col("o_custkey") % 3 == 1) & (n > 2), moved).otherwise(F.col("raw"))
    found = rows.select("o_custkey", V.stored_in_track(stored, F.col("raw")).alias("at"))
    return found.select("o_custkey", F.coalesce(F.size("at"), F.lit(-1)).alias("n"))


@query("""SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 AND event_type = 'click'""")
def j10_taken(spark, sf_dir):
    """Messages whose ids were in the queue."""
    events = table(spark, sf_dir, "events")
    return A.taken(events.filter("event_id % 3 = 0").select("event_id"), events.filter("event_type = 'click'").select("event_id", "user_id"), "event_id")[1]


@query(
    """SELECT o_orderkey, CASE WHEN c_nationkey % 3 = 0 THEN 'Order ' || o_orderkey ELSE 'Auftrag ' || o_orderkey END AS title, 't' || c_custkey AS token FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'"""
)
def j09_per_device(spark, sf_dir):
    """Each message for each device, in its language."""
    devices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"), F.when(F.col("c_nationkey") % 3 == 0, "en").when(F.col("c_nationkey") % 3 == 1, "de").otherwise("fr").alias("locale"))
    payload = orders(spark, sf_dir).filter("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    key = F.col("o_orderkey").cast("string")
    return A.per_device(payload, devices, {"en": F.concat(F.lit("Order "), key), "de": F.concat(F.lit("Auftrag "), key)}, "de").select("o_orderkey", "title", "token")


@query(
    """WITH c AS (SELECT l_partkey AS trail_id, l_suppkey AS same_as, l_orderkey AS user_id, min(l_shipdate) AS created_at, bool_or(l_returnflag = 'R') AS reversed FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2, 3)
SELECT trail_id, same_as, arg_min(reversed, (created_at, user_id)) AS reversed, string_agg(user_id::VARCHAR, ',' ORDER BY created_at, user_id) AS by_users FROM c GROUP BY 1, 2"""
)
def a16_grouped_claims(spark, sf_dir):
    """Claims of each pair: direction of the first one, and who made them in order."""
    claims = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("trail_id"), F.col("l_suppkey").alias("same_as"), F.col("l_orderkey").alias("user_id")).agg(F.min("l_shipdate").alias("created_at"), F.bool_or(F.col("l_returnflag") == "R").alias("reversed"))
    return A.grouped_claims(claims).withColumn("by_users", F.array_join(F.transform("by_users", lambda u: u.cast("string")), ","))


@query(
    """WITH b AS (SELECT l_suppkey AS user_id, l_partkey AS trail_id, max(l_quantity) AS air, max(l_discount) AS longest, max(date_trunc('month', l_shipdate)) AS month FROM lineitem GROUP BY 1, 2), m AS (SELECT user_id, CASE WHEN trail_id % 4 = 1 THEN trail_id - 1 ELSE trail_id END AS trail_id, trail_id % 4 <> 1 AS own, air, longest, month FROM b)
SELECT user_id, trail_id, max(air) AS air, max(longest) AS longest, arg_max(month, (air, own))::DATE::VARCHAR AS month FROM m GROUP BY 1, 2"""
)
def m11_moved_bests(spark, sf_dir):
    """Bests after trails became aliases of others."""
    lines = table(spark, sf_dir, "lineitem")
    bests = lines.groupBy(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("trail_id")).agg(F.max("l_quantity").alias("air"), F.max("l_discount").alias("longest"), F.max(F.trunc("l_shipdate", "MM")).alias("month"))
    aliases = bests.filter("trail_id % 4 = 1").select("user_id", "trail_id", (F.col("trail_id") - 1).alias("same_as"))
    return A.moved_bests(bests, aliases).withColumn("month", F.col("month").cast("string"))


@query(
    """WITH k AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O')
SELECT r.o_custkey, o_orderkey FROM r LEFT JOIN k USING (o_custkey) WHERE place + coalesce(n, 0) <= 6"""
)
def m15_within_limit(spark, sf_dir):
    """New rows that each account may still add."""
    rows = orders(spark, sf_dir)
    return A.within_limit(rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus = 'O'"), "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")], 6).select("o_custkey", "o_orderkey")


@query(
    f"""WITH {FRIENDS}, r AS (SELECT me, friend FROM f UNION ALL SELECT c_custkey, c_custkey * 3 % 100 FROM customer), g AS (SELECT x, y FROM e WHERE x % 2 = 0)
SELECT me, friend, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE (x = me AND y = friend) OR (y = me AND x = friend)) GROUP BY 1, 2"""
)
def m18_without_friends(spark, sf_dir):
    """Rows between accounts once friendships have ended (cascades of M15)."""
    edges = friend_edges(spark, sf_dir)
    both = edges.select(F.col("requester").alias("me"), F.col("addressee").alias("friend")).unionByName(edges.select(F.col("addressee").alias("me"), F.col("requester").alias("friend")))
    others = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("me"), (F.col("c_custkey") * 3 % 100).alias("friend"))
    ended = edges.filter("requester % 2 = 0").select(F.col("requester").alias("requester_id"), F.col("addressee").alias("addressee_id"))
    return A.without_friends(both.unionByName(others), ended, "me", "friend").groupBy("me", "friend").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND (c_acctbal < 0 OR c_acctbal / 100 >= 24)""")
def j32_sweepable(spark, sf_dir):
    """Objects without a live row that are not fresh."""
    objects = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100).alias("hours"))
    live = orders(spark, sf_dir).filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return A.sweepable(objects, live, "c_custkey", "hours", 24).select("c_custkey")


@query(f"WITH {FRIENDS}, p AS (SELECT c_custkey AS u, c_custkey + 1 + c_nationkey AS b FROM customer WHERE c_acctbal > 0) SELECT u AS user_id FROM p WHERE b = 9 AND EXISTS (SELECT 1 FROM f WHERE me = u AND friend = b)")
def j35_choosers(spark, sf_dir):
    """Friends who chose one account as theirs."""
    edges = friend_edges(spark, sf_dir)
    friends = edges.select(F.col("requester").alias("user_id"), F.col("addressee").alias("buddy_id")).unionByName(edges.select(F.col("addressee").alias("user_id"), F.col("requester").alias("buddy_id")))
    prefs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") + 1 + F.col("c_nationkey")).alias("buddy_id"), (F.col("c_acctbal") > 0).alias("chosen"), F.lit(False).alias("hidden"))
    return A.choosers(prefs, friends, F.lit(9))


@query(
    """SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE (user_id = 3 AND event_id % 15 = 7) OR (user_id = 7 AND event_id % 15 = 3)"""
)
def f28_conversation(spark, sf_dir):
    """Messages between two accounts by time."""
    messages = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("sender_id"), (F.col("event_id") % 15).alias("recipient_id"), F.col("ts").alias("created_at"))
    return A.conversation(messages, F.lit(3), F.lit(7)).select("id", F.col("place").cast("long").alias("place"))


@query(
    """SELECT o_custkey AS user_id, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 10 = 3) DESC, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 50000) END NULLS LAST, lower(o_orderpriority), o_orderkey) AS place FROM orders"""
)
def o11_start_choices(spark, sf_dir):
    """Start points in the order in which they are offered."""
    distance = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 50000))
    points = orders(spark, sf_dir).select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"), distance.alias("d"))
    last = F.when(F.col("key") % 10 == 3, F.col("key"))
    return A.start_choices(points, last).select("user_id", "key", F.col("place").cast("long").alias("place"))


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '5-LOW' AND o_totalprice > 50000) AS hidden FROM orders GROUP BY 1""")
def f09_hidden_without_grade(spark, sf_dir):
    """Rows that a filter hides only because they have no grade."""
    grade = F.when(F.col("o_orderpriority") != "5-LOW", F.left("o_orderpriority", F.lit(1)).cast("int"))
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.count_if(grade.isNull() & (F.col("o_totalprice") > 50000)).alias("hidden"))


@query("""SELECT l_orderkey AS ride_id FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND NOT bool_or(l_returnflag = 'R' AND l_linenumber = 1)""")
def f23_ridden(spark, sf_dir):
    """Rides that count as ridden: not planned, and of at least two points."""
    rides = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ride_id")).agg(F.count("*").alias("points"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("planned"))
    return rides.filter("not planned and points >= 2").select("ride_id")


@query("""SELECT p_partkey FROM part WHERE p_size < 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def j31_places_only(spark, sf_dir):
    """Found places that are not among the found points of interest."""
    points = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf_dir, "part").filter("p_size < 25").select("p_partkey").join(points, "p_partkey", "left_anti")


@query(
    """WITH r AS (SELECT l_partkey AS trail_id, l_suppkey AS user_id, CASE l_returnflag WHEN 'A' THEN 'app' WHEN 'N' THEN 'import' ELSE 'planned' END AS source FROM lineitem WHERE l_quantity > 48), t AS (SELECT trail_id, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE source = 'app') AS app FROM r GROUP BY 1),
o AS (SELECT DISTINCT l_partkey AS a, l_partkey + l_suppkey + 1 AS b, l_suppkey / 10.0 AS ab, (l_partkey % 11) / 10.0 AS ba FROM lineitem), e AS (SELECT o.*, least(ab, ba) AS low FROM o WHERE a IN (SELECT trail_id FROM t) AND b IN (SELECT trail_id FROM t))
SELECT 'users' AS label, (SELECT count(DISTINCT user_id) FROM r) AS n UNION ALL SELECT 'recordings', (SELECT count(*) FROM r) UNION ALL SELECT 'app', (SELECT count(*) FROM r WHERE source = 'app') UNION ALL SELECT 'planned', (SELECT count(*) FROM r WHERE source = 'planned') UNION ALL SELECT 'trails', (SELECT count(*) FROM t)
UNION ALL SELECT 'single', (SELECT count(*) FROM t WHERE n = 1) UNION ALL SELECT 'double', (SELECT count(*) FROM t WHERE n = 2) UNION ALL SELECT 'several', (SELECT count(*) FROM t WHERE n >= 3) UNION ALL SELECT 'shared', (SELECT count(*) FROM t WHERE users >= 2) UNION ALL SELECT 'several_app', (SELECT count(*) FROM t WHERE n >= 2 AND app >= 1)
UNION ALL SELECT 'most', (SELECT max(n) FROM t) UNION ALL SELECT 'edges', (SELECT count(*) FROM e) UNION ALL SELECT 'twins', (SELECT count(*) FROM e WHERE low >= 0.5) UNION ALL SELECT 'twins_at_several', (SELECT count(*) FROM e WHERE low >= 0.5 AND EXISTS (SELECT 1 FROM t WHERE n >= 2 AND trail_id IN (a, b)))"""
)
def a18_matcher_statistics(spark, sf_dir):
    """Figures of recordings and of the overlaps between their trails."""
    lines = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_returnflag") == "A", "app").when(F.col("l_returnflag") == "N", "import").otherwise("planned")
    recordings = lines.filter("l_quantity > 48").select(F.col("l_partkey").alias("trail_id"), F.col("l_suppkey").alias("user_id"), source.alias("source"))
    overlaps = lines.select(F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_suppkey") + 1).alias("b"), (F.col("l_suppkey") / 10).alias("ab"), ((F.col("l_partkey") % 11) / 10).alias("ba")).distinct()
    return A.matcher_statistics(recordings, overlaps)


@query(
    """SELECT CASE WHEN p >= 60000 THEN 3 WHEN p >= 30000 THEN 2 WHEN p >= 10000 THEN 1 ELSE 0 END AS band, count(*) AS n, count(*) FILTER (WHERE d > 2 * t) AS downhill, round(median(p), 4) AS middle FROM (SELECT l_extendedprice AS p, l_discount * 100 AS d, l_tax * 100 AS t FROM lineitem) GROUP BY 1"""
)
def a21_tracks_report(spark, sf_dir):
    """Tracks by length, and how many of them go down."""
    tracks = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("length"), (F.col("l_tax") * 100).alias("gain"), (F.col("l_discount") * 100).alias("loss"))
    return A.tracks_report(tracks, [10000, 30000, 60000]).withColumn("middle", F.round("middle", 4))


@query(
    """WITH p AS (SELECT l_partkey AS a, (l_partkey + l_suppkey) % (SELECT count(*) FROM part) AS b, l_returnflag AS class FROM lineitem) SELECT class, x.p_name = y.p_name AS same_name, count(*) AS n FROM p JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b GROUP BY 1, 2"""
)
def a24_name_confusion(spark, sf_dir):
    """Classes of pairs by whether both have one name."""
    part = table(spark, sf_dir, "part")
    n = part.agg(F.count("*").alias("n"))
    pairs = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_partkey").alias("a"), ((F.col("l_partkey") + F.col("l_suppkey")) % F.col("n")).alias("b"), F.col("l_returnflag").alias("class"))
    return A.name_confusion(pairs, part.select("p_partkey", "p_name"))


@query("""SELECT p_brand AS build, count(*) AS tiles, count(*) FILTER (WHERE p_size < 10) AS empty, sum(p_size) AS bytes, round(sum(p_retailprice) / 1000, 4) AS seconds FROM part GROUP BY 1""")
def a41_build_stats(spark, sf_dir):
    """Tiles, empty tiles, bytes and seconds of each build."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("build")).agg(F.count("*").alias("tiles"), F.count_if(F.col("p_size") < 10).alias("empty"), F.sum("p_size").alias("bytes"), F.round(F.sum("p_retailprice") / 1000, 4).alias("seconds"))


GRID = """c AS (SELECT count(*) AS n FROM part), nd AS (SELECT p_partkey AS node, (p_partkey % 20) * 100.0 AS x, (p_partkey // 20) * 100.0 AS y FROM part),
ed AS (SELECT p_partkey AS a, p_partkey + 1 AS b, 100.0 + p_size AS cost FROM part WHERE p_partkey % 20 < 19 UNION ALL SELECT p_partkey + 1, p_partkey, 100.0 + p_size FROM part WHERE p_partkey % 20 < 19 UNION ALL SELECT p_partkey, p_partkey + 20, 110.0 + p_size FROM part UNION ALL SELECT p_partkey + 20, p_partkey, 140.0 + p_size FROM part)"""


def grid(spark, sf_dir):
    """(edges, nodes) of a street grid of blocks of 100 m: parts are its crossings, twenty in a row."""
    k, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    nodes = part.select(k.alias("node"), ((k % 20) * 100.0).alias("x"), (F.floor(k / 20) * 100.0).alias("y"))
    row = part.filter(k % 20 < 19)
    edges = row.select(k.alias("a"), (k + 1).alias("b"), (size + 100.0).alias("cost"))
    edges = edges.unionByName(row.select((k + 1).alias("a"), k.alias("b"), (size + 100.0).alias("cost")))
    edges = edges.unionByName(part.select(k.alias("a"), (k + 20).alias("b"), (size + 110.0).alias("cost"))).unionByName(part.select((k + 20).alias("a"), k.alias("b"), (size + 140.0).alias("cost")))
    there = nodes.select("node")
    return edges.join(there.toDF("a"), "a", "left_semi").join(there.toDF("b"), "b", "left_semi"), nodes


WAYS = f"""{GRID}, w AS (SELECT s AS source, s AS node, 0.0::DOUBLE AS cost FROM (VALUES (0), (5), (64)) v(s) UNION SELECT w.source, ed.b, w.cost + ed.cost FROM w JOIN ed ON ed.a = w.node JOIN nd ON nd.node = ed.b WHERE w.cost + ed.cost <= 900), best AS (SELECT source, node, min(cost) AS cost FROM w GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {WAYS} SELECT source::BIGINT AS source, node::BIGINT AS goal, cost FROM best WHERE (source, node) IN ((0, 43), (5, 8), (64, 25))")
def r11_goal_directed(spark, sf_dir):
    """The cheapest way to a goal, without following ways that cannot beat the best one known."""
    edges, nodes = grid(spark, sf_dir)
    return R.cheapest_between(edges, spark.createDataFrame([(0, 43), (5, 8), (64, 25)], "source long, goal long"), nodes, 1.0)


@query(f"WITH RECURSIVE {WAYS} SELECT 1::BIGINT AS route_id, a.cost + b.cost AS cost, 2::BIGINT AS legs FROM best a, best b WHERE a.source = 0 AND a.node = 5 AND b.source = 5 AND b.node = 48")
def r25_through_vias(spark, sf_dir):
    """The cheapest way through via points; a route with a leg that has no way is missing."""
    edges, nodes = grid(spark, sf_dir)
    routes = spark.createDataFrame([(1, [0, 5, 48]), (2, [0, -1])], "route_id long, stops array<long>")
    return R.through_vias(routes, edges, nodes, 1.0)


@query(
    f"""WITH RECURSIVE {GRID}, h AS (SELECT ed.*, degrees(atan2(q.x - p.x, q.y - p.y)) AS heading FROM ed JOIN nd p ON p.node = a JOIN nd q ON q.node = b), o AS (SELECT * FROM h WHERE abs((heading - 45 + 540 + 360) % 360 - 180) <= 100),
f AS (SELECT 1 AS s, 0.0::DOUBLE AS cost UNION SELECT h.b, f.cost + h.cost FROM f JOIN h ON h.a = f.s WHERE f.cost + h.cost <= 800), n AS (SELECT 1 AS s, 0.0::DOUBLE AS cost UNION SELECT o.b, n.cost + o.cost FROM n JOIN o ON o.a = n.s WHERE n.cost + o.cost <= 800),
m AS (SELECT g AS goal, (SELECT min(cost) FROM f WHERE s = g) AS free, (SELECT min(cost) FROM n WHERE s = g) AS onward FROM (VALUES (0), (22), (43)) v(g))
SELECT 1::BIGINT AS source, goal::BIGINT AS goal, CASE WHEN onward IS NULL OR onward - free > 180 THEN free ELSE onward END AS cost, onward IS NULL OR onward - free > 180 AS turns FROM m"""
)
def r21_replanned(spark, sf_dir):
    """Ways from a place on a course: turning back only where there is no other way or it saves much."""
    edges, nodes = grid(spark, sf_dir)
    at = edges.join(nodes.toDF("a", "ax", "ay"), "a").join(nodes.toDF("b", "bx", "by"), "b").withColumn("heading", F.degrees(F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))))
    back = R.points_back(at, F.lit(45.0)).select("a", "b")
    pairs = spark.createDataFrame([(1, 0), (1, 22), (1, 43)], "source long, goal long")
    free = R.cheapest_between(edges, pairs, nodes, 1.0)
    return R.replanned(free, R.cheapest_between(edges.join(back, ["a", "b"], "left_anti"), pairs, nodes, 1.0))


@query(
    """SELECT o_orderkey, CASE WHEN s > 5000 OR e > 5000 THEN 'too-far' WHEN o_orderstatus = 'F' THEN 'connector' WHEN o_orderpriority = '1-URGENT' THEN 'warned' ELSE 'in-reach' END AS pool FROM (SELECT *, o_totalprice / 50 AS s, o_totalprice / 40 AS e FROM orders)"""
)
def r23_pools(spark, sf_dir):
    """Trails by how a loop may use them."""
    trails = orders(spark, sf_dir).select("o_orderkey", (F.col("o_totalprice") / 50).alias("start_m"), (F.col("o_totalprice") / 40).alias("end_m"), (F.col("o_orderstatus") != "F").alias("downhill"), (F.col("o_orderpriority") == "1-URGENT").alias("warns"))
    return R.pool_of(trails, 5000.0).select("o_orderkey", "pool")


@query(
    """WITH s AS (SELECT o_custkey AS route_id, o_orderkey, o_orderstatus AS cls, o_totalprice AS m, row_number() OVER w - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS g FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), r AS (SELECT route_id, cls, g, min(o_orderkey) AS first, sum(m) AS metres FROM s GROUP BY 1, 2, 3)
SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY first) AS section, cls, round(metres, 2) AS metres FROM r"""
)
def r24_class_sections(spark, sf_dir):
    """Runs of one class along each route."""
    steps = orders(spark, sf_dir).select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("cls"), F.col("o_totalprice").alias("metres"))
    return R.class_sections(steps).withColumn("metres", F.round("metres", 2)).withColumn("section", F.col("section").cast("long"))


@query(
    """WITH s AS (SELECT p_brand AS route_id, p_partkey * 10.0 AS start_m, p_partkey * 10.0 + 10 + p_size % 3 * 0 AS stop_m, p_name || p_partkey AS name FROM part), n AS (SELECT *, lead(name) OVER (PARTITION BY route_id ORDER BY start_m) AS next_name FROM s), f AS (SELECT (SELECT p_brand FROM part WHERE p_partkey = l_partkey) AS route_id, l_orderkey * 100 + l_linenumber AS seq, l_partkey * 10.0 + l_quantity / 4 AS done_m FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)
SELECT f.route_id, f.seq, n.name, n.next_name FROM f LEFT JOIN n ON n.route_id = f.route_id AND done_m >= start_m AND done_m < stop_m"""
)
def w24_sections_at(spark, sf_dir):
    """The section of a route where each fix is, and the next one."""
    part = table(spark, sf_dir, "part")
    sections = part.select(F.col("p_brand").alias("route_id"), (F.col("p_partkey") * 10.0).alias("start_m"), (F.col("p_partkey") * 10.0 + 10).alias("stop_m"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    from ..operators.groups import best_per_group

    first = best_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity")])
    fixes = first.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("route_id")), "l_partkey").select("route_id", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") * 10.0 + F.col("l_quantity") / 4).alias("done_m"))
    return R.sections_at(fixes, sections).select("route_id", "seq", "name", "next_name")


@query(
    """WITH e AS (SELECT c_custkey AS edge_id, c_custkey % 2 AS cut, (c_custkey % 17) * 1.0 + 0.5 AS x FROM customer)
SELECT edge_id, part, CASE WHEN cut = 0 THEN 4 WHEN part = 0 THEN (CASE WHEN x <= 10 THEN 2 WHEN x <= 15 THEN 3 ELSE 4 END) ELSE (CASE WHEN x <= 10 THEN 4 WHEN x <= 15 THEN 3 ELSE 2 END) END AS n FROM e, range(2) t(part) WHERE cut = 1 OR part = 0"""
)
def r04_split_edges(spark, sf_dir):
    """Points of both parts of edges that are cut at a place."""
    k = F.col("c_custkey")
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y")) for x in (0.0, 10.0, 15.0, 40.0)])
    edges = table(spark, sf_dir, "customer").select(k.alias("edge_id"), line.alias("points"))
    places = table(spark, sf_dir, "customer").filter(k % 2 == 1).select(k.alias("edge_id"), ((k % 17) * 1.0 + 0.5).alias("x"), F.lit(0.0).alias("y"))
    return R.split_edges(edges, places).select("edge_id", F.col("part").cast("long").alias("part"), F.size("points").alias("n"))


@query(
    """WITH RECURSIVE t AS (SELECT p_partkey AS node, p_partkey // 3 AS up FROM part WHERE p_partkey > 0), w AS (SELECT p_partkey AS goal, 0 AS back, p_partkey AS node FROM part WHERE p_size = 7 UNION ALL SELECT goal, back + 1, up FROM w JOIN t USING (node))
SELECT goal, back, node * 2 AS edge_id FROM w WHERE node > 0"""
)
def r12_walked_back(spark, sf_dir):
    """The edges of each path of a tree, numbered from its goal back."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    edges = part.filter("p_partkey > 0").select(F.floor(k / 3).alias("a"), k.alias("b"), (k * 2).alias("edge_id"))
    best = part.select(F.lit(0).cast("long").alias("source"), k.alias("node"), F.when(k > 0, k * 2).alias("via"))
    goals = part.filter("p_size = 7").select(F.lit(0).cast("long").alias("source"), k.alias("goal"))
    return N.walked_back(best, edges, goals).select("goal", "back", "edge_id")
