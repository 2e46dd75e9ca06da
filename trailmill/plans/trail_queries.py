"""Trail-network, routing and tile operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing as R
from ..operators import groups as G
from ..operators import tiles as Z
from ..operators import trails as T
from .catalog import query, table


@query(
    """SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 OR o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 90 DAY"""
)
def m14_swept(spark, sf_dir):
    """Orders that a sweep after 90 days leaves: the newest of each customer always stays."""
    return T.swept(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", F.lit("1998-08-02").cast("timestamp")).select("o_orderkey")


@query(
    """WITH a AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS grade FROM customer WHERE c_acctbal > -500),
b AS (SELECT c_custkey, c_name AS name, c_nationkey + 100 AS grade FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(a.name, b.name, '') AS name, coalesce(a.grade, b.grade, -1) AS grade FROM a FULL JOIN b ON a.c_custkey = b.c_custkey"""
)
def m04_merged_details(spark, sf_dir):
    """Details of one table filled up, field by field, from another."""
    c = table(spark, sf_dir, "customer")
    kept = c.filter("c_acctbal > -500").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("grade"))
    other = c.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_nationkey") + 100).alias("grade"))
    return T.merged_details(kept, other, "c_custkey", ["name", "grade"]).na.fill({"name": "", "grade": -1})


@query(
    """SELECT 'lines' AS tab, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT 'keys', count(*) FROM supplier WHERE s_acctbal < 0"""
)
def m09_withdrawn(spark, sf_dir):
    """How many rows of each table a withdrawal takes away."""
    gone = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("trail_id"), F.lit(1).alias("user_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("trail_id"), F.lit(1).alias("user_id"))
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("trail_id"), F.lit(1).alias("user_id"))
    return T.without_contribution({"lines": lines, "keys": keys}, gone)[1].withColumnRenamed("table", "tab")


@query(
    """SELECT l_partkey, l_suppkey, round(l_quantity * 100 / (CASE WHEN l_linenumber < 6 THEN [16, 12, 9, 6, 4, 4][l_linenumber + 1] ELSE 10 END / 3.6), 3) AS seconds FROM lineitem"""
)
def c25_trail_time(spark, sf_dir):
    """Seconds down a trail by its grade."""
    grade = F.when(F.col("l_linenumber") < 6, F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.round(R.trail_time(F.col("l_quantity") * 100, grade), 3).alias("seconds"))


@query(
    """SELECT p_partkey, round(CASE WHEN g <= 0.10 THEN 0 ELSE least(30, exp((g - 0.22) / 0.0455) - exp((0.10 - 0.22) / 0.0455)) END, 5) AS weight FROM (SELECT p_partkey, p_size / 100.0::DOUBLE AS g FROM part)"""
)
def g20_steep_weight(spark, sf_dir):
    """Weight of a grade."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(R.steep_weight(F.col("p_size") / 100.0), 5).alias("weight"))


@query(
    """SELECT p_partkey, 1 + least((CASE WHEN r >= 5 THEN 0.3 WHEN r = 4 THEN 0.15 ELSE 0 END) + 0.6 * least(greatest(n, 0), 5) / 5, 0.8) AS weight FROM (SELECT p_partkey, p_size % 7 AS r, p_size // 8 AS n FROM part)"""
)
def c26_preference(spark, sf_dir):
    """Weight of a trail by rating and rides."""
    return table(spark, sf_dir, "part").select("p_partkey", R.preference_weight(F.col("p_size") % 7, F.floor(F.col("p_size") / 8)).alias("weight"))


@query(
    """SELECT p_partkey, CASE WHEN h <= 1 THEN 5000.0 WHEN h <= 2 THEN 5000 + 3000 * (h - 1) WHEN h <= 3 THEN 8000 + 4000 * (h - 2) WHEN h <= 4 THEN 12000 + 3000 * (h - 3) ELSE 15000.0 END::DOUBLE AS reach FROM (SELECT p_partkey, (p_size / 10.0)::DOUBLE AS h FROM part)"""
)
def r16_reach(spark, sf_dir):
    """How far to look around for so many hours."""
    return table(spark, sf_dir, "part").select("p_partkey", R.reach_radius(F.col("p_size") / 10.0).alias("reach"))


@query(
    """WITH e(cls, up, down, hiking, pushing, pathy, steep) AS (VALUES ('forest_road', 1.0, 1.0, false, false, false, 3.0), ('cycleway', 1.0, 1.0, false, false, false, 1.0), ('steps', 3.0, 3.0, true, true, false, 0.0), ('footway', 2.0, 2.5, true, false, true, 3.0)),
l AS (SELECT l_orderkey, l_linenumber, l_partkey, (['forest_road', 'cycleway', 'steps', 'footway'])[l_partkey % 4 + 1] AS cls, l_quantity * 50 AS length, l_discount * 1000 AS gain, l_tax * 1000 AS loss FROM lineitem),
c AS (SELECT l.*, e.*, CASE WHEN pushing THEN 300 WHEN pathy THEN 350 ELSE 450 END / 3600.0 AS rate FROM l JOIN e USING (cls)),
t AS (SELECT *, length / (CASE WHEN pushing THEN 3 WHEN loss > gain THEN CASE WHEN hiking THEN 8 ELSE 25 END WHEN pathy THEN 8 ELSE 15 END / 3.6) + gain / rate AS seconds FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round(seconds * CASE WHEN loss > gain THEN down ELSE up END + 0.3 * loss / rate + CASE WHEN pushing AND gain > loss THEN 60 ELSE 0 END, 2) AS cost FROM t"""
)
def c24_edge_cost(spark, sf_dir):
    """Cost of edges of four classes for one rider."""
    k = F.col("l_partkey") % 4
    cls = F.when(k == 0, "forest_road").when(k == 1, "cycleway").when(k == 2, "steps").otherwise("footway")
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cls.alias("cls"), (F.col("l_quantity") * 50).alias("length"), (F.col("l_discount") * 1000).alias("gain"), (F.col("l_tax") * 1000).alias("loss"))
    told = edges.join(F.broadcast(R.class_table(spark)), "cls").crossJoin(F.broadcast(R.rider_table(spark).filter("rider = 'muscle'")))
    for name, kind in (("steep_w", "double"), ("carry", "double"), ("way", "int"), ("uphill", "int")):
        told = told.withColumn(name, F.lit(None).cast(kind))
    return told.select("l_orderkey", "l_linenumber", "l_partkey", F.round(R.edge_cost(), 2).alias("cost"))


@query(
    """SELECT z, state, count(*) AS n FROM (SELECT coalesce(a.z, b.z) AS z, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.e = b.e THEN 'same' WHEN a.l = b.l THEN 'same-length' ELSE 'other-length' END AS state
FROM (SELECT o_custkey AS k, min(o_custkey) % 5 AS z, count(*) AS l, max(o_orderpriority) AS e FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, min(o_custkey) % 5 AS z, count(*) AS l, max(o_orderpriority) AS e FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1) b ON a.k = b.k) GROUP BY 1, 2"""
)
def j29_archive_diff(spark, sf_dir):
    """States of keys between two archives, by zoom."""
    of = lambda year: table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == year).groupBy(F.col("o_custkey").alias("tile_id")).agg((F.min("o_custkey") % 5).cast("int").alias("z"), F.count("*").alias("length"), F.max("o_orderpriority").alias("etag"))
    return Z.archive_diff(of(1996), of(1997)).select("z", "state", "n")


@query(
    """WITH t AS (SELECT event_id AS tile_id, event_type AS content FROM events), m AS (SELECT *, CASE WHEN tile_id = lag(tile_id) OVER (ORDER BY tile_id) + 1 AND content = lag(content) OVER (ORDER BY tile_id) THEN 0 ELSE 1 END AS fresh FROM t),
r AS (SELECT *, sum(fresh) OVER (ORDER BY tile_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT min(tile_id) AS tile_id, count(*) AS run_length, any_value(content) AS content FROM r GROUP BY run"""
)
def k02_directory_runs(spark, sf_dir):
    """A run-length directory of consecutive ids with one content."""
    return Z.directory_runs(table(spark, sf_dir, "events").select(F.col("event_id").alias("tile_id"), F.col("event_type").alias("content")))


@query(
    """SELECT DISTINCT l_orderkey AS tile_id FROM lineitem WHERE l_suppkey % 10 < 3 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_suppkey % 10 >= 3"""
)
def j33_orphan_tiles(spark, sf_dir):
    """Tiles that nothing refers to once some areas are gone."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("area_id"), F.col("l_orderkey").alias("tile_id"))
    removed = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 < 3").select(F.col("s_suppkey").alias("area_id"))
    return Z.orphans_after(refs, removed)


@query(
    """SELECT c_custkey, coalesce((SELECT min(p) FROM (VALUES (1, 0, 12, 0, 3000), (2, 5, 20, -999, 9999), (3, 0, 24, 0, 9999)) r(p, n0, n1, b0, b1) WHERE c_nationkey BETWEEN n0 AND n1 AND c_acctbal BETWEEN b0 AND b1), 0)::INT AS region FROM customer"""
)
def j39_first_region(spark, sf_dir):
    """The first region of a list that holds a point."""
    regions = spark.createDataFrame([(1, 0, 12, 0.0, 3000.0), (2, 5, 20, -999.0, 9999.0), (3, 0, 24, 0.0, 9999.0)], "p int, n0 int, n1 int, b0 double, b1 double")
    inside = F.col("c_nationkey").between(F.col("n0"), F.col("n1")) & F.col("c_acctbal").between(F.col("b0"), F.col("b1"))
    return table(spark, sf_dir, "customer").join(F.broadcast(regions), inside, "left").groupBy("c_custkey").agg(F.coalesce(F.min("p"), F.lit(0)).alias("region"))


@query(
    """SELECT o_orderstatus, o_orderkey, place FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE WHEN o_totalprice <= 200000 THEN substr(o_orderpriority, 1, 1)::INT ELSE 9 END, o_totalprice, o_orderkey) AS place FROM orders) WHERE place <= 20"""
)
def o02_search_sections(spark, sf_dir):
    """The best hits of each section: by match while near, then by distance."""
    rank = F.when(F.col("o_totalprice") <= 200000, F.substring("o_orderpriority", 1, 1).cast("int")).otherwise(9)
    best = table(spark, sf_dir, "orders").withColumn("rank", rank)
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("o_orderstatus").orderBy("rank", "o_totalprice", "o_orderkey"))
    return best.withColumn("place", place).filter("place <= 20").select("o_orderstatus", "o_orderkey", "place")


@query(
    """WITH m AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 3), t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 7), k AS (SELECT l_partkey FROM lineitem WHERE l_suppkey = 11), p AS (SELECT l_partkey FROM lineitem WHERE l_suppkey = 13)
SELECT (SELECT count(*) FROM m WHERE l_partkey IN (SELECT l_partkey FROM t)) AS shared, (SELECT count(*) FROM t WHERE l_partkey NOT IN (SELECT l_partkey FROM m) AND l_partkey NOT IN (SELECT l_partkey FROM k)) AS new_from_buddy,
  (SELECT count(*) FROM m WHERE l_partkey NOT IN (SELECT l_partkey FROM t) AND l_partkey NOT IN (SELECT l_partkey FROM p)) AS new_for_buddy"""
)
def a44_connection(spark, sf_dir):
    """What two accounts share, and what is new for each of them."""
    from ..operators.visibility import connection_summary

    of = lambda s: table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") == s).select(F.col("l_partkey").alias("trail_id"))
    return connection_summary(of(3), of(7), of(11), of(13))


@query(
    """SELECT l_suppkey, min(l_quantity) AS least, max(l_quantity) AS most, list_sort(list(l_quantity))[(count(*) // 2 + 1)::INT] AS middle FROM lineitem GROUP BY 1"""
)
def a04_rating(spark, sf_dir):
    """Range and upper median of votes of each supplier."""
    lines = table(spark, sf_dir, "lineitem")
    ranges = lines.groupBy("l_suppkey").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    return ranges.join(G.upper_median_of_groups(lines, ["l_suppkey"], "l_quantity").withColumnRenamed("median", "middle"), "l_suppkey")


@query(
    """WITH s AS (SELECT p_partkey % 100 AS ride_id, p_partkey AS first_t, p_partkey + p_size * 10 AS last_t FROM part),
e AS (SELECT l_suppkey AS ride_id, l_partkey AS t, l_quantity AS seconds, ['jump', 'wheelie', 'landing'][l_linenumber % 3 + 1] AS kind, l_returnflag <> 'R' AS plausible FROM lineitem),
m AS (SELECT s.ride_id, first_t, last_t, count(*) FILTER (WHERE kind = 'jump' AND plausible) AS jumps, coalesce(sum(seconds) FILTER (WHERE kind = 'jump' AND plausible), 0)::DOUBLE AS air, (max(seconds) FILTER (WHERE kind = 'jump' AND plausible))::DOUBLE AS longest, count(*) FILTER (WHERE kind = 'wheelie') AS wheelies FROM s JOIN e ON s.ride_id = e.ride_id AND t BETWEEN first_t AND last_t GROUP BY 1, 2, 3)
SELECT s.ride_id::BIGINT AS ride_id, s.first_t::BIGINT AS first_t, s.last_t::BIGINT AS last_t, coalesce(jumps, 0) AS jumps, air, longest, coalesce(wheelies, 0) AS wheelies FROM s LEFT JOIN m USING (ride_id, first_t, last_t)"""
)
def j19_event_values(spark, sf_dir):
    """Jumps and wheelies inside each section of a ride, lines as events."""
    from ..operators.sensors import event_values

    k = F.col("p_partkey").cast("long")
    sections = table(spark, sf_dir, "part").select((k % 100).alias("ride_id"), k.alias("first_t"), (k + F.col("p_size") * 10).alias("last_t"))
    kind = F.get(F.array(F.lit("jump"), F.lit("wheelie"), F.lit("landing")), (F.col("l_linenumber") % 3).cast("int"))
    events = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("ride_id"), F.col("l_partkey").cast("long").alias("t"), F.col("l_quantity").cast("double").alias("seconds"), kind.alias("kind"), (F.col("l_returnflag") != "R").alias("plausible"))
    return event_values(events, sections).fillna(0, ["jumps", "wheelies"])


@query(
    """WITH p AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS pair_low, greatest(l_partkey, l_suppkey) AS pair_high FROM lineitem WHERE l_partkey <> l_suppkey),
v AS (SELECT least(o_custkey, o_orderkey % 100) AS pair_low, greatest(o_custkey, o_orderkey % 100) AS pair_high FROM orders)
SELECT pair_low::BIGINT AS pair_low, pair_high::BIGINT AS pair_high FROM p WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.pair_low = p.pair_low AND v.pair_high = p.pair_high)"""
)
def m05_undistinct(spark, sf_dir):
    """Pairs of trails that nobody has marked as distinct."""
    from ..operators.setops import without_pairs

    def pairs(df, a, b):
        return df.select(F.least(a, b).cast("long").alias("pair_low"), F.greatest(a, b).cast("long").alias("pair_high"))

    found = pairs(table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey"), F.col("l_partkey"), F.col("l_suppkey")).distinct()
    return without_pairs(found, pairs(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey") % 100))
