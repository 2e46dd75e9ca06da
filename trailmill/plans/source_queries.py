"""Sources parsed from lines that are made of the test tables, and joins in time and space."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import overlays as O
from ..operators import sensors as E
from ..operators import visibility as V
from ..sources import records as S
from .catalog import query, table
from .set_queries import FRIENDS, friend_edges


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t_us, value, CASE event_type WHEN 'click' THEN 'a' WHEN 'error' THEN 'e' WHEN 'purchase' THEN 'w' ELSE 'z' END AS kind FROM events), o AS (SELECT user_id, min(t_us) FILTER (WHERE kind IN ('a', 'w')) AS origin FROM e GROUP BY 1)
SELECT user_id, kind, count(*) AS n, round(sum(value), 3) AS total, round(max((t_us - origin) / 1e6), 3) AS last FROM e JOIN o USING (user_id) WHERE kind <> 'z' GROUP BY 1, 2"""
)
def s13_sensor_log(spark, sf_dir):
    """Sensor logs: samples and detections by kind, with times from the first sample."""
    kind = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "error", "e").when(F.col("event_type") == "purchase", "w").otherwise("z")
    text = F.concat_ws(",", kind, F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.col("value").cast("string"), F.lit("1.5"))
    events = table(spark, sf_dir, "events")
    lines = events.select(F.col("user_id").cast("string").alias("path"), text.alias("value")).unionByName(events.select(F.col("user_id").cast("string").alias("path"), F.lit("a,odd,1").alias("value")))
    found = S.sensor_log(lines)
    return found.groupBy(F.col("path").cast("long").alias("user_id"), "kind").agg(F.count("*").alias("n"), F.round(F.sum(F.get("v", F.lit(0))), 3).alias("total"), F.round(F.max("t"), 3).alias("last"))


@query(
    """SELECT o_custkey AS ride, count(*) FILTER (WHERE o_orderstatus = 'O') AS points, count(*) FILTER (WHERE o_orderstatus = 'F') AS marks, coalesce(max(o_orderdate) FILTER (WHERE o_orderstatus = 'O'), TIMESTAMP '1990-01-01')::DATE::VARCHAR AS ended FROM orders GROUP BY 1"""
)
def s14_ride_files(spark, sf_dir):
    """Ride files of JSON lines: points, marks, and when each ride ended."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    point = F.to_json(F.struct(at.alias("at"), F.lit(47.5).alias("lat"), (F.col("o_orderkey") % 90).cast("double").alias("lng")))
    mark = F.to_json(F.struct(at.alias("at"), F.lit("start").alias("kind"), F.col("o_orderpriority").alias("name")))
    orders = table(spark, sf_dir, "orders")
    path = F.col("o_custkey").cast("string").alias("path")
    lines = orders.filter("o_orderstatus in ('O', 'F')").select(path, F.when(F.col("o_orderstatus") == "O", point).otherwise(mark).alias("value"))
    heads = orders.select(path).distinct().select("path", F.to_json(F.struct(F.col("path").alias("id"), F.lit("1990-01-01T00:00:00").alias("startedAt"))).alias("value"))
    parts = S.ride_files(lines.unionByName(heads))
    counts = parts["points"].groupBy("path").agg(F.count("*").alias("points")), parts["marks"].groupBy("path").agg(F.count("*").alias("marks"))
    rides = parts["rides"].join(counts[0], "path", "left").join(counts[1], "path", "left").na.fill(0, ["points", "marks"])
    return rides.select(F.col("path").cast("long").alias("ride"), "points", "marks", F.to_date("ended_at").cast("string").alias("ended"))


@query("""SELECT 'p' || p_partkey AS id, p_brand AS brand, 'Point' AS geometry_type, (p_partkey % 180)::DOUBLE AS lon, (p_size)::DOUBLE AS lat FROM part""")
def s10_geojson_sequence(spark, sf_dir):
    """Features of a GeoJSON text sequence, with and without record separators."""
    k = F.col("p_partkey")
    feature = F.to_json(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array((k % 180).cast("double"), F.col("p_size").cast("double")).alias("coordinates")).alias("geometry")))
    lines = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, F.concat(F.lit("\x1e"), feature)).otherwise(feature).alias("value"))
    found = S.geojson_sequence(lines.unionByName(lines.limit(1).select(F.lit("  ").alias("value"))))
    centre = S.box_centre(F.col("coordinates"))
    return found.select("id", F.try_element_at("tags", F.lit("brand")).alias("brand"), "geometry_type", centre["lon"].alias("lon"), centre["lat"].alias("lat"))


@query("""SELECT 'c' || c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer""")
def s17_tab_bundle(spark, sf_dir):
    """Records of a bundle of keys and JSON."""
    record = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("\t"), record).alias("value"))
    return S.tab_bundle(lines, "name string, nation int")


@query(
    """SELECT isoyear(ts)::INT * 100 + week(ts)::INT AS week, event_type AS context, 'e' || user_id % 3 AS error_type, count(*) AS n, string_agg(DISTINCT (event_id % 4)::VARCHAR, ',' ORDER BY (event_id % 4)::VARCHAR) AS versions, arg_min(event_id::VARCHAR, ts) AS example FROM events GROUP BY 1, 2, 3"""
)
def o09_error_digest(spark, sf_dir):
    """Errors of each week by context and type."""
    errors = table(spark, sf_dir, "events").select(F.col("ts").alias("created_at"), F.col("event_type").alias("context"), F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string")).alias("error_type"), (F.col("event_id") % 4).cast("string").alias("app_version"), F.lit("x").alias("platform"), F.col("event_id").cast("string").alias("message"))
    return S.error_digest(errors).select("week", "context", "error_type", "n", F.array_join("versions", ",").alias("versions"), "example")


@query(
    f"""WITH {FRIENDS}, p AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') SELECT me AS viewer, count(*) AS lines FROM f JOIN orders ON o_custkey = friend WHERE friend NOT IN (SELECT c_custkey FROM p) GROUP BY 1"""
)
def j05_friends_lines(spark, sf_dir):
    """How many lines of friends each account sees."""
    customer = table(spark, sf_dir, "customer")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    private = customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("owner"))
    seen = V.visible_to(customer.select(F.col("c_custkey").alias("viewer")), rows, friend_edges(spark, sf_dir), private)
    return seen.filter("viewer <> owner").groupBy("viewer").agg(F.count("*").alias("lines"))


@query(
    """WITH c AS (SELECT c_custkey AS id, c_acctbal / 200.0 AS lat, (c_custkey * 37 % 40) * 0.05 AS lon FROM customer), k AS (SELECT id, floor(lat / 0.045) AS r, floor(lon / (0.045 / greatest(cos(radians((floor(lat / 0.045) + 0.5) * 0.045)), 0.01))) AS c FROM c)
SELECT a.id, count(*) AS near FROM k a JOIN k b ON a.id <> b.id AND a.r = b.r AND a.c = b.c GROUP BY 1"""
)
def j36_same_cell(spark, sf_dir):
    """Accounts in one's own cell."""
    k = F.col("c_custkey")
    cells = table(spark, sf_dir, "customer").select(k.alias("id"), G.near_cell(F.col("c_acctbal") / 200.0, (k * 37 % 40) * 0.05).alias("c")).select("id", "c.row", "c.column")
    sizes = cells.groupBy("row", "column").agg((F.count("*") - 1).alias("near")).filter("near > 0")
    return cells.join(sizes, ["row", "column"]).select("id", "near")


@query(
    """WITH w AS (SELECT user_id AS ride_id, event_id AS win, value / 100 AS rotation FROM events WHERE event_type <> 'error')
SELECT ride_id, win, CASE WHEN count(*) OVER o >= 12 THEN median(rotation) OVER o > 0.35 END AS pocket FROM w WINDOW o AS (PARTITION BY ride_id ORDER BY win ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
)
def f24_in_pocket(spark, sf_dir):
    """Calm windows in which the phone is in a pocket, by the median of the last twelve."""
    windows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ride_id"), F.col("event_id").alias("window"), (F.col("value") / 100).alias("rotation"), (F.col("event_type") != "error").alias("calm"))
    return E.in_pocket(windows).select("ride_id", F.col("window").alias("win"), "pocket")


@query(
    """WITH s AS (SELECT user_id AS ride_id, epoch_us(ts) AS t, value FROM events), m AS (SELECT *, avg(value) OVER (PARTITION BY ride_id ORDER BY t RANGE BETWEEN 36000000000 PRECEDING AND CURRENT ROW) AS mean, floor(t / 86400000000) AS tick FROM s)
SELECT ride_id, t, round(mean, 6) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY ride_id, tick ORDER BY t) = 1"""
)
def w17_sampled_mean(spark, sf_dir):
    """The mean of the last ten hours at the first event of each day."""
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("ride_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("mean"))
    found = O.sampled_mean(samples, ["mean"], 36000.0, 86400.0)
    return found.select("ride_id", F.round(F.col("t") * 1e6).cast("long").alias("t"), F.round("mean", 6).alias("mean"))


@query(
    """WITH o AS (SELECT c_nationkey AS region, c_custkey AS id, c_acctbal > 0 AS up FROM customer), n AS (SELECT region, id, up AND NOT (region % 5 = 1 AND id % 4 > 0) AS up FROM o WHERE NOT (region % 5 = 0 AND id % 2 = 0)),
g AS (SELECT region, count(o.id) AS was, count(n.id) AS fresh, count(*) FILTER (WHERE n.id IS NOT NULL AND o.up AND NOT n.up) AS closing FROM o LEFT JOIN n USING (region, id) GROUP BY 1),
v AS (SELECT *, CASE WHEN (was - fresh) * 3 > was THEN 'gone' WHEN closing * 3 > was THEN 'closed' ELSE 'ok' END AS verdict FROM g),
r AS (SELECT n.* FROM n JOIN v USING (region) WHERE verdict = 'ok' UNION ALL SELECT o.* FROM o JOIN v USING (region) WHERE verdict <> 'ok')
SELECT region, any_value(was) AS was, any_value(fresh) AS now, any_value(closing) AS closing, any_value(verdict) AS verdict, count(*) AS n, count(*) FILTER (WHERE up) AS open FROM r JOIN v USING (region) GROUP BY 1"""
)
def k07_published(spark, sf_dir):
    """A second version behind the gates: what each region had and has, why it was refused, and what is published now."""
    import uuid

    from ..scratch import scratch_root
    from ..sources import publish as P

    old = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("region"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("up"))
    new = old.filter("not (region % 5 = 0 and id % 2 = 0)").withColumn("up", F.expr("up and not (region % 5 = 1 and id % 4 > 0)"))
    path = f"{scratch_root(spark)}/published-{uuid.uuid4().hex}"
    P.publish(spark, path, old, F.col("up"))
    report = P.publish(spark, path, new, F.col("up"))
    shown = P.published(spark, path).groupBy("region").agg(F.count("*").alias("n"), F.count_if("up").alias("open"))
    return shown.join(report, "region").select("region", "was", "now", "closing", "verdict", "n", "open")


@query(
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1"""
)
def k08_written_once(spark, sf_dir):
    """Contributions under one client id, sent in two overlapping requests and once again: each id is written once."""
    import uuid

    from ..scratch import scratch_root
    from ..sources import publish as P

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    early = rows.withColumn("__half", F.min("o_orderkey").over(W.partitionBy("o_custkey")) % 2).filter("__half = 0").drop("__half")
    path = f"{scratch_root(spark)}/written-{uuid.uuid4().hex}"
    order = [F.asc("o_orderkey")]
    one, two, three = (P.write_once(spark, path, r, "o_custkey", order) for r in (early, rows, rows))
    return one.unionByName(two).unionByName(three)
