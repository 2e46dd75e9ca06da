"""Functions on tracks, boxes, tags, names and packets over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import folds as D
from ..functions import geo as G
from ..functions import routing as R
from ..functions import shapes as S
from ..functions import text as T
from ..functions import tracks as K
from ..operators import groups as A
from ..operators import rides as I
from ..operators import visibility as V
from ..sources.records import box_centre
from .catalog import query, table
from .spatial_queries import PLACES, places, vectors

POINTS = "pt AS (SELECT vec_id AS line_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, range(32) t(i))"
SEGMENTS = f"{POINTS}, sg AS (SELECT * FROM (SELECT line_id, i, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM pt WINDOW w AS (PARTITION BY line_id ORDER BY i)) WHERE bx IS NOT NULL)"


def box(x0, y0, x1, y1):
    """A box of given corners."""
    return F.struct(*[F.lit(v).alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


@query(
    f"""WITH {SEGMENTS}, c AS (SELECT line_id, CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN 0.3 AND 0.4 THEN 0 ELSE 2 END ELSE least((0.3 - ax) / (bx - ax), (0.4 - ax) / (bx - ax)) END AS x0, CASE WHEN bx = ax THEN 1 ELSE greatest((0.3 - ax) / (bx - ax), (0.4 - ax) / (bx - ax)) END AS x1,
CASE WHEN b_y = ay THEN CASE WHEN ay BETWEEN -0.1 AND 0.1 THEN 0 ELSE 2 END ELSE least((-0.1 - ay) / (b_y - ay), (0.1 - ay) / (b_y - ay)) END AS y0, CASE WHEN b_y = ay THEN 1 ELSE greatest((-0.1 - ay) / (b_y - ay), (0.1 - ay) / (b_y - ay)) END AS y1 FROM sg)
SELECT DISTINCT line_id FROM c WHERE greatest(x0, y0, 0) <= least(x1, y1, 1)"""
)
def f10_line_in_box(spark, sf_dir):
    """Polylines of which any part lies in a box."""
    return vectors(spark, sf_dir).filter(G.line_meets_box(F.col("points"), box(0.3, -0.1, 0.4, 0.1))).select("line_id")


@query(
    f"""WITH {POINTS}, b AS (SELECT line_id, min(x + line_id * 37 % 10 * 0.25) AS x0, min(y) AS y0, max(x + line_id * 37 % 10 * 0.25) AS x1, max(y) AS y1 FROM pt GROUP BY 1)
SELECT a.line_id, NOT (a.x0 - 0.05 > b.x1 OR b.x0 - 0.05 > a.x1 OR a.y0 - 0.05 > b.y1 OR b.y0 - 0.05 > a.y1) AS near FROM b a JOIN b ON b.line_id = a.line_id + 1"""
)
def f12_boxes_near(spark, sf_dir):
    """Does the box of each moved line lie near that of the next one?"""
    moved = F.transform("points", lambda p: F.struct((p["x"] + F.col("line_id") * 37 % 10 * 0.25).alias("x"), p["y"].alias("y")))
    boxes = vectors(spark, sf_dir).select("line_id", G.box_of(moved).alias("a"))
    following = boxes.select((F.col("line_id") - 1).alias("line_id"), F.col("a").alias("b"))
    return boxes.join(following, "line_id").select("line_id", G.boxes_near(F.col("a"), F.col("b"), 0.05).alias("near"))


@query("SELECT l_orderkey AS ride_id, count(*) AS n FROM lineitem WHERE l_linenumber = 1 OR l_quantity <= 30 GROUP BY 1")
def f13_usable(spark, sf_dir):
    """Fixes that are accurate enough, or tell no accuracy."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ride_id"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("acc_m"))
    return I.usable(points).groupBy("ride_id").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 3 THEN 'fragment' WHEN (l_suppkey % 3) < 2 OR l_extendedprice > 60000 THEN 'planned' WHEN l_extendedprice < 8000 AND l_discount * 1000 > 2 * l_tax * 1000 THEN 'trail' ELSE 'ride' END AS kind,
CASE l_returnflag WHEN 'A' THEN 0.6 WHEN 'N' THEN 0.4 END AS quality FROM lineitem"""
)
def f14_track_kind(spark, sf_dir):
    """What kind each recorded track is, and how much it is trusted."""
    length = F.when(F.col("l_quantity") < 3, F.lit(10.0)).otherwise(F.greatest("l_extendedprice", F.lit(50.0)))
    planned = K.looks_planned((F.col("l_suppkey") % 3), F.col("l_extendedprice") / 1000)
    source = F.when(F.col("l_returnflag") == "A", "app").when(F.col("l_returnflag") == "N", "import").otherwise("else")
    kind = K.track_kind(length, F.col("l_tax") * 1000, F.col("l_discount") * 1000, planned)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"), K.quality_of(source).alias("quality"))


@query(
    """SELECT o_custkey, CASE WHEN bool_and(h BETWEEN -500 AND 9000) THEN count(*) ELSE -1 END::INT AS n FROM (SELECT o_custkey, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_totalprice / 50 END AS h FROM orders) GROUP BY 1 HAVING count(*) = count(h)
UNION ALL SELECT o_custkey, -1 FROM orders GROUP BY 1 HAVING count_if(o_orderkey % 53 = 0) > 0"""
)
def f15_valid_heights(spark, sf_dir):
    """How many heights each series has if all of them are there and plausible, else -1."""
    h = F.when(F.col("o_orderkey") % 53 != 0, F.col("o_totalprice") / 50)
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.collect_list(F.struct(h.alias("h"))), lambda s: s["h"]).alias("hs"))
    return rows.select("o_custkey", F.coalesce(F.size(G.valid_heights(F.col("hs"))), F.lit(-1)).alias("n"))


def part_tags():
    """Tags of a part as a map."""
    return F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.when(F.col("p_size") > 40, "large").otherwise("small"))


@query(
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN NULL WHEN p_type = 'ECONOMY' AND p_size > 40 THEN 'big' WHEN p_type = 'ECONOMY' THEN 'plain' WHEN p_size > 40 THEN 'large' END AS kind, p_type = 'PROMO' AND p_size <= 40 AS small_promo FROM part"""
)
def f16_first_kind(spark, sf_dir):
    """The first kind whose tags match, and whether all of some tags do."""
    kinds = [("big", {"type": "ECONOMY", "size": "large"}), ("plain", {"type": "ECONOMY"}), ("large", {"size": "large"})]
    kind = T.first_matching_kind(part_tags(), kinds, {"brand": ["Brand#13"]})
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), T.tags_match(part_tags(), {"type": "PROMO", "size": "small"}).alias("small_promo"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN access IN ('private', 'no') THEN NULL WHEN kind = 'major_road' THEN CASE WHEN detail LIKE 'primary%' THEN 'trunk_road' ELSE 'main_road' END WHEN kind = 'medium_road' THEN 'country_road'
WHEN kind = 'minor_road' THEN CASE WHEN detail <> 'service' THEN 'side_road' WHEN service = 'alley' THEN 'access_road' END
WHEN kind = 'path' THEN CASE detail WHEN 'track' THEN 'forest_road' WHEN 'cycleway' THEN 'cycleway' WHEN 'path' THEN 'path' WHEN 'footway' THEN 'footway' WHEN 'steps' THEN 'steps' END END AS cls
FROM (SELECT *, (['major_road', 'medium_road', 'minor_road', 'path', 'rail'])[l_partkey % 5 + 1] AS kind, (['primary_link', 'service', 'track', 'cycleway', 'path', 'footway', 'steps', 'ferry'])[l_suppkey % 8 + 1] AS detail,
(['yes', 'private', 'permissive'])[l_linenumber % 3 + 1] AS access, (['alley', 'driveway'])[l_orderkey % 2 + 1] AS service FROM lineitem)"""
)
def f17_road_class(spark, sf_dir):
    """Class of a road by its tags."""
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    kind = pick(["major_road", "medium_road", "minor_road", "path", "rail"], F.col("l_partkey") % 5)
    detail = pick(["primary_link", "service", "track", "cycleway", "path", "footway", "steps", "ferry"], F.col("l_suppkey") % 8)
    cls = R.road_class(kind, detail, pick(["yes", "private", "permissive"], F.col("l_linenumber") % 3), pick(["alley", "driveway"], F.col("l_orderkey") % 2))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cls.alias("cls"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'off' WHEN o_orderpriority = '1-URGENT' THEN 'no-position' WHEN h < 1000 THEN 'home' WHEN s IS NOT NULL THEN CASE WHEN s < 1000 THEN 'near-start' END WHEN o_custkey % 2 = 0 THEN 'background' WHEN h IS NULL THEN 'no-home' END AS reason
FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 20 END AS h, CASE WHEN o_orderkey % 5 > 2 THEN o_totalprice / 30 END AS s FROM orders)"""
)
def f26_pause_reason(spark, sf_dir):
    """Why a presence is not shared, the first reason that holds."""
    home, start = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 20), F.when(F.col("o_orderkey") % 5 > 2, F.col("o_totalprice") / 30)
    reason = R.pause_reason(F.col("o_orderstatus") != "F", F.col("o_orderpriority") != "1-URGENT", home, start, F.col("o_custkey") % 2 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("""SELECT p_partkey, p_name || '+' || p_brand AS name FROM part""")
def c07_decoded(spark, sf_dir):
    """Percent-encoded names decoded; a plus stays one."""
    coded = F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+"), F.replace("p_brand", F.lit("#"), F.lit("%23")))
    return table(spark, sf_dir, "part").select("p_partkey", T.decoded_name(coded).alias("name"))


@query("""SELECT conv_id, turn, nullif(left(trim(text || '  '), 40), '') AS name FROM conversations""")
def c08_clean_name(spark, sf_dir):
    """Trimmed names of bounded length; blank ones are null."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_name(F.concat("text", F.lit("  ")), 40).alias("name"))


@query(
    """SELECT p_partkey, list_distinct(list_filter(list_transform(string_split_regex(lower(p_name || ' ' || p_type || '-a-' || p_name), '[^a-z0-9]+'), lambda w: replace(replace(replace(replace(w, 'ae', 'a'), 'oe', 'o'), 'ue', 'u'), 'ss', 's')), lambda w: length(w) >= 2)).len()::INT AS words FROM part"""
)
def c11_search_words(spark, sf_dir):
    """How many distinct search words a name has."""
    return table(spark, sf_dir, "part").select("p_partkey", F.size(T.search_words(F.concat_ws(" ", "p_name", F.concat("p_type", F.lit("-a-"), "p_name")))).alias("words"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE ((round(o_totalprice * 100)::BIGINT // 10 + 5) // 10)::INT END AS metres FROM orders""")
def c15_elevation(spark, sf_dir):
    """Metres from texts in several notations."""
    tenths = F.floor(F.round(F.col("o_totalprice") * 100) / 10)
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.concat(text, F.lit(" m"))).when(F.col("o_orderkey") % 4 == 1, F.replace(text, F.lit("."), F.lit(","))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("  "), text, F.lit("m"))).otherwise(F.concat(F.lit("about "), text))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.elevation_of(shown).alias("metres"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN greatest(l_linenumber % 3, 1) WHEN l_returnflag = 'R' THEN l_linenumber % 3 END AS worst FROM lineitem""")
def c16_worst(spark, sf_dir):
    """The highest rank among the parts of a list; unknown parts do not count."""
    name = F.get(F.array(*map(F.lit, ("good", "bad", "horrible"))), F.col("l_linenumber") % 3)
    tags = F.when(F.col("l_returnflag") == "A", F.concat(name, F.lit("; bad"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("odd;"), name)).otherwise("odd")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", T.worst_of(tags, {"good": 0, "bad": 1, "horrible": 2}).alias("worst"))


@query("""SELECT c_custkey, ('https://x.org/' || c_custkey) AS link FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 3 > 0""")
def c12_links(spark, sf_dir):
    """Links that are safe, trimmed; null for all others."""
    k = F.col("c_custkey")
    link = F.when(k % 3 == 0, F.concat(F.lit("  https://x.org/"), k.cast("string"), F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("http://x.org/"), k.cast("string"))).otherwise(F.lit("https://x.org/a b"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.safe_link(link).alias("link"))


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 4 < 3 THEN (['n', 'w', 'r'])[l_linenumber % 4 + 1] WHEN l_partkey % 2 = 0 THEN 'w' ELSE 'r' END AS kind, CASE WHEN l_linenumber % 4 < 3 THEN l_partkey ELSE l_partkey // 2 END AS id FROM lineitem"""
)
def c14_osm_id(spark, sf_dir):
    """Kind and number of coded map objects; areas come from ways or relations by parity."""
    code = F.concat(F.get(F.array(*map(F.lit, "nwra")), F.col("l_linenumber") % 4), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", T.osm_id(code).alias("o")).select("l_orderkey", "l_partkey", "l_linenumber", "o.kind", "o.id")


@query(
    """SELECT c_custkey, c_nationkey - 12 AS high, (c_custkey % 60000 - 30000)::INT AS low, ((c_nationkey - 12)::INT << 16 | ((c_custkey % 60000 - 30000)::INT & 65535)) AS packed FROM customer WHERE c_nationkey >= 12
UNION ALL SELECT c_custkey, c_nationkey - 12, (c_custkey % 60000 - 30000)::INT, ((c_nationkey - 12) * 65536 + ((c_custkey % 60000 - 30000)::INT & 65535))::INT FROM customer WHERE c_nationkey < 12"""
)
def c40_packed(spark, sf_dir):
    """Two signed numbers in one and back."""
    high, low = F.col("c_nationkey") - 12, (F.col("c_custkey") % 60000 - 30000).cast("int")
    rows = table(spark, sf_dir, "customer").select("c_custkey", S.packed_pair(high, low).alias("packed"))
    return rows.select("c_custkey", S.unpacked_pair(F.col("packed")).alias("p"), "packed").select("c_custkey", "p.high", "p.low", "packed")


@query(
    """SELECT o_custkey, round(max(4700000 + s) / 1e5, 5) AS lat, round(max(1100000 - t) / 1e5, 5) AS lon, count(*)::INT + 1 AS n FROM (SELECT o_custkey, sum(o_orderkey % 1000) OVER w AS s, sum(o_orderkey % 777) OVER w AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) GROUP BY 1"""
)
def c31_route_points(spark, sf_dir):
    """Northmost point, westmost point and number of points of routes decoded from packed steps."""
    step = S.packed_pair(F.col("o_orderkey") % 1000, -(F.col("o_orderkey") % 777))
    packed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", step.alias("p")))), lambda s: s["p"]).alias("steps"))
    points = packed.select("o_custkey", S.route_points(F.lit(4700000), F.lit(1100000), F.col("steps")).alias("r")).filter("size(r) > 1")
    inner = F.slice("r", 2, F.size("r"))
    return points.select("o_custkey", F.round(F.array_max(F.transform(inner, lambda p: p["lat"])), 5).alias("lat"), F.round(F.array_max(F.transform(inner, lambda p: p["lon"])), 5).alias("lon"), F.size("r").alias("n"))


@query("SELECT c_custkey, v.* FROM customer JOIN (VALUES ('muscle', 450.0::DOUBLE, 15.0::DOUBLE, 800.0::DOUBLE), ('electric', 850.0, 20.0, 1400.0)) v(rider, climb_track, v_flat, climb_budget) ON rider = CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'electric' ELSE 'muscle' END")
def r19_riders(spark, sf_dir):
    """Parameters of each account's rider."""
    chosen = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "electric").otherwise("muscle")
    accounts = table(spark, sf_dir, "customer").select("c_custkey", chosen.alias("rider"))
    return accounts.join(F.broadcast(R.rider_table(spark)), "rider").select("c_custkey", "rider", "climb_track", "v_flat", "climb_budget")


@query(f"WITH {PLACES} SELECT id, round(lon * cos(radians(47.0)) * pi() / 180 * 6371000, 3) AS x, round(lat * pi() / 180 * 6371000, 3) AS y, round(lat, 9) AS lat, round(lon, 9) AS lon FROM pl")
def g03_projected(spark, sf_dir):
    """Places on a plane, and back in degrees."""
    flat = G.projected(F.array(F.struct("lat", "lon")), F.lit(47.0))
    back = lambda p: G.unprojected(p, F.lit(47.0))
    rows = places(spark, sf_dir).withColumn("p", flat).withColumn("q", back(F.col("p")))
    return rows.select("id", F.round(F.get("p", F.lit(0))["x"], 3).alias("x"), F.round(F.get("p", F.lit(0))["y"], 3).alias("y"), F.round(F.get("q", F.lit(0))["lat"], 9).alias("lat"), F.round(F.get("q", F.lit(0))["lon"], 9).alias("lon"))


@query(f"WITH {PLACES} SELECT id, CASE WHEN lat < 0 THEN 'EPSG:327' ELSE 'EPSG:326' END || lpad((1 + floor((lon + 180) / 6))::INT::VARCHAR, 2, '0') AS zone FROM pl WHERE lon < 180")
def g04_utm(spark, sf_dir):
    """Code of the UTM zone of each place."""
    return places(spark, sf_dir).filter("lon < 180").select("id", F.concat(F.lit("EPSG:"), G.utm_zone(F.col("lat"), F.col("lon")).cast("string")).alias("zone"))


@query(
    f"""WITH {SEGMENTS}, p AS (SELECT line_id, x, y FROM pt WHERE i = 0), t AS (SELECT s.line_id, p.x - ax AS ux, p.y - ay AS uy, bx - ax AS dx, b_y - ay AS dy FROM sg s JOIN p ON p.line_id = s.line_id + 1)
SELECT line_id, round(sqrt(min(pow(ux - k * dx, 2) + pow(uy - k * dy, 2))), 6) AS d FROM (SELECT *, greatest(0, least(1, (ux * dx + uy * dy) / (dx * dx + dy * dy))) AS k FROM t) GROUP BY 1"""
)
def g08_point_line(spark, sf_dir):
    """Distance of the next line's beginning from each line."""
    lines = vectors(spark, sf_dir)
    start = lines.select((F.col("line_id") - 1).alias("line_id"), F.get("points", F.lit(0)).alias("p"))
    return lines.join(start, "line_id").select("line_id", F.round(G.distance_to_line(F.col("p"), F.col("points")), 6).alias("d"))


@query(
    f"""WITH {SEGMENTS}, c AS (SELECT line_id, i, unnest([ax + (bx - ax) * 0.25, ax + (bx - ax) * 0.75]) AS x, unnest([ay + (b_y - ay) * 0.25, ay + (b_y - ay) * 0.75]) AS y, unnest([0, 1]) AS k FROM sg),
k AS (SELECT line_id, x, y FROM c WHERE NOT (i = 0 AND k = 0) AND NOT (i = 30 AND k = 1) UNION ALL SELECT line_id, x, y FROM pt WHERE i IN (0, 31))
SELECT line_id, count(*)::INT AS n, round(sum(x), 6) AS sx, round(sum(y), 6) AS sy FROM k GROUP BY 1"""
)
def g15_corners_cut(spark, sf_dir):
    """Points and sums of lines whose corners are cut once."""
    cut = vectors(spark, sf_dir).select("line_id", S.corners_cut(F.col("points")).alias("c"))
    total = lambda axis: F.round(F.aggregate("c", F.lit(0.0), lambda a, p: a + p[axis]), 6)
    return cut.select("line_id", F.size("c").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query(
    f"""WITH {POINTS}, r AS (SELECT line_id, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS b_y FROM pt WINDOW w AS (PARTITION BY line_id ORDER BY i))
SELECT line_id, 64 AS n, round(sum(ax + bx), 6) AS sx, round(sum(abs(ax + (bx - ax) * 0.25) + abs(ax + (bx - ax) * 0.75)), 6) AS size FROM r GROUP BY 1"""
)
def g16_ring_cut(spark, sf_dir):
    """Points and sums of rings whose corners are cut once."""
    cut = vectors(spark, sf_dir).select("line_id", S.corners_cut(F.col("points"), closed=True).alias("c"))
    return cut.select("line_id", F.size("c").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda a, p: a + p["x"]), 6).alias("sx"), F.round(F.aggregate("c", F.lit(0.0), lambda a, p: a + F.abs(p["x"])), 6).alias("size"))


@query(
    """SELECT vec_id, CASE WHEN label = 0 THEN NULL ELSE round(h[1] * (1 - fx) * (1 - fy) + h[2] * fx * (1 - fy) + h[3] * (1 - fx) * fy + h[4] * fx * fy, 6) END AS height
FROM (SELECT vec_id, label, embedding[1:4]::DOUBLE[] AS h, abs(embedding[5]::DOUBLE) AS fx, abs(embedding[6]::DOUBLE) AS fy FROM embeddings)"""
)
def g18_bilinear(spark, sf_dir):
    """Heights between four raster points; none where one of them has no data."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    corner = F.when(F.col("label") != 0, e(1)).otherwise(-32768.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(G.height_at(F.array(e(0), corner, e(2), e(3)), 2, F.abs(e(4)), F.abs(e(5))), 6).alias("height"))


@query(
    f"""WITH {POINTS}, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM pt WINDOW w AS (PARTITION BY line_id ORDER BY i)), p AS (SELECT line_id, i, y * 100 AS e, sum(d) OVER (PARTITION BY line_id ORDER BY i) AS d FROM s),
k AS (SELECT a.line_id, a.d, a.e, b.d AS d2, b.e AS e2 FROM p a JOIN p b ON a.line_id = b.line_id AND b.i = a.i + 1)
SELECT line_id, round(e + (e2 - e) * (1.0 - d) / (d2 - d), 6) AS at_one, (SELECT round(max(e), 6) FROM p WHERE p.line_id = k.line_id) AS highest FROM k WHERE d <= 1.0 AND d2 > 1.0"""
)
def g19_profile(spark, sf_dir):
    """Height one unit along each line's profile, and its highest point."""
    raised = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["y"] * 100).alias("z")))
    steps = vectors(spark, sf_dir).select("line_id", S.profile(raised).alias("s"))
    at_one = F.round(S.height_on_profile(F.col("s"), F.lit(1.0)), 6)
    return steps.filter(F.element_at("s", -1)["d"] > 1.0).select("line_id", at_one.alias("at_one"), F.round(F.array_max(F.transform("s", lambda p: p["e"])), 6).alias("highest"))


@query(f"WITH {PLACES}, c AS (SELECT id, floor(lat / 0.045) AS r, lon FROM pl) SELECT id, r::INT AS row, floor(lon / (0.045 / greatest(cos(radians((r + 0.5) * 0.045)), 0.01)))::INT AS col FROM c")
def g29_near_cell(spark, sf_dir):
    """Cells of about equal sides."""
    return places(spark, sf_dir).select("id", G.near_cell(F.col("lat"), F.col("lon")).alias("c")).select("id", "c.row", F.col("c.column").alias("col"))


@query(f"WITH {POINTS} SELECT line_id, round((min(x) + max(x)) / 2, 6) AS lon, round((min(y) + max(y)) / 2, 6) AS lat FROM pt GROUP BY 1")
def g28_box_centre(spark, sf_dir):
    """Middle of a geometry given as text."""
    text = F.to_json(F.transform("points", lambda p: F.array(p["x"], p["y"])))
    centre = vectors(spark, sf_dir).select("line_id", box_centre(text).alias("c"))
    return centre.select("line_id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query(
    f"""WITH {POINTS}, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM pt WINDOW w AS (PARTITION BY line_id ORDER BY i))
SELECT line_id, round(min(y), 6) AS low, round(max(y), 6) AS high, round(sum(greatest(y - py, 0)), 6) AS up, round(sum(d), 6) AS long FROM (SELECT *, lag(y) OVER (PARTITION BY line_id ORDER BY i) AS py FROM s) GROUP BY 1"""
)
def g35_profile_stats(spark, sf_dir):
    """Least and greatest height, climb and length of each profile."""
    raised = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["y"].alias("z")))
    steps = vectors(spark, sf_dir).select("line_id", S.profile(raised).alias("s"))
    heights, long = F.transform("s", lambda p: p["e"]), F.element_at("s", -1)["d"]
    return steps.select("line_id", F.round(F.array_min(heights), 6).alias("low"), F.round(F.array_max(heights), 6).alias("high"), F.round(S.climb_between(F.col("s"), F.lit(0.0), long), 6).alias("up"), F.round(long, 6).alias("long"))


@query(
    f"""WITH {SEGMENTS}, h AS (SELECT line_id, i, degrees(atan2(bx - ax, b_y - ay)) AS h FROM sg), t AS (SELECT *, lag(h) OVER (PARTITION BY line_id ORDER BY i) AS p FROM h)
SELECT line_id, count_if(abs((h - p + 540 + 360) % 360 - 180) >= 120)::INT AS sharp, round(sum(abs((h - p + 540 + 360) % 360 - 180)), 3) AS turned FROM t WHERE p IS NOT NULL GROUP BY 1"""
)
def w23_turns(spark, sf_dir):
    """Sharp turns of each line and how far it turns in all."""
    turned = vectors(spark, sf_dir).select("line_id", F.transform(S.turns(F.col("points")), F.abs).alias("t"))
    return turned.select("line_id", F.size(F.filter("t", lambda t: t >= 120)).alias("sharp"), F.round(F.aggregate("t", F.lit(0.0), lambda a, t: a + t), 3).alias("turned"))


@query(
    f"""WITH {POINTS}, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM pt WINDOW w AS (PARTITION BY line_id ORDER BY i)), p AS (SELECT line_id, i, y AS e, sum(d) OVER (PARTITION BY line_id ORDER BY i) AS d FROM s),
g AS (SELECT a.line_id, a.d, a.e, b.d AS d2, b.e AS e2 FROM p a JOIN p b ON a.line_id = b.line_id AND b.i = a.i + 1 WHERE a.d < 2 AND b.d > 1),
c AS (SELECT line_id, CASE WHEN d < 1 THEN e + (e2 - e) * (1 - d) / (d2 - d) ELSE e END AS e, CASE WHEN d2 > 2 THEN e + (e2 - e) * (2 - d) / (d2 - d) ELSE e2 END AS e2 FROM g)
SELECT line_id, round(sum(greatest(e2 - e, 0)), 6) AS up FROM c WHERE line_id IN (SELECT line_id FROM p GROUP BY 1 HAVING max(d) > 2) GROUP BY 1"""
)
def w25_climb_between(spark, sf_dir):
    """Climb between two places along each line."""
    raised = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["y"].alias("z")))
    steps = vectors(spark, sf_dir).select("line_id", S.profile(raised).alias("s")).filter(F.element_at("s", -1)["d"] > 2)
    return steps.select("line_id", F.round(S.climb_between(F.col("s"), F.lit(1.0), F.lit(2.0)), 6).alias("up"))


@query("""SELECT c_custkey, c_acctbal < 0 OR c_acctbal > 5000 AS there FROM customer""")
def f05_unexpired(spark, sf_dir):
    """Rows whose date of expiry is not past, or that have none."""
    at = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.unexpired(at, F.lit(5000.0)).alias("there"))


@query("""SELECT c_custkey, CASE WHEN rate < sqrt(450.0 * 850.0) * 0.9 THEN 'muscle' WHEN rate > sqrt(450.0 * 850.0) * 1.1 THEN 'electric' END AS rider FROM (SELECT c_custkey, abs(c_acctbal) / 8 AS rate FROM customer)""")
def a48_guessed_rider(spark, sf_dir):
    """The rider that a climb rate tells of."""
    return table(spark, sf_dir, "customer").select("c_custkey", I.guessed_rider(F.abs("c_acctbal") / 8).alias("rider"))


@query(
    """SELECT p_partkey, CASE WHEN hw = 'track' THEN CASE WHEN g = 5 OR p_size % 4 = 3 OR mud THEN 7 WHEN g <= 2 THEN 1 WHEN g = 3 THEN 2 WHEN g = 4 THEN 3 END ELSE CASE WHEN sac <= 1 THEN 4 WHEN sac = 2 THEN 5 WHEN sac = 3 THEN 6 ELSE 8 END END AS way
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'track' ELSE 'path' END AS hw, p_size % 5 + 1 AS g, p_size % 6 + 1 AS sac, p_partkey % 7 = 0 AS mud FROM part)"""
)
def a50_way_class(spark, sf_dir):
    """Class of a way by its tags."""
    even, size = F.col("p_partkey") % 2 == 0, F.col("p_size")
    smooth = F.get(F.array(*map(F.lit, ("excellent", "good", "intermediate", "bad"))), size % 4)
    sac = F.get(F.array(*map(F.lit, R.SAC_SCALE)), size % 6)
    tags = F.when(
        even, F.create_map(F.lit("highway"), F.lit("track"), F.lit("tracktype"), F.concat(F.lit("grade"), (size % 5 + 1).cast("string")), F.lit("smoothness"), smooth, F.lit("surface"), F.when(F.col("p_partkey") % 7 == 0, "gravel; mud").otherwise("gravel"))
    ).otherwise(F.create_map(F.lit("highway"), F.lit("path"), F.lit("sac_scale"), sac))
    return table(spark, sf_dir, "part").select("p_partkey", R.way_class(tags).alias("way"))


@query(
    """WITH RECURSIVE h AS (SELECT o_custkey AS k, o_orderkey AS o, round(o_totalprice / 5000) AS e FROM orders), n AS (SELECT k, e, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS i FROM h),
f AS (SELECT k, 0::BIGINT AS i, e AS top, e AS bottom, 0 AS runs, 0.0::DOUBLE AS fall FROM n WHERE i = 0
 UNION ALL SELECT f.k, n.i, CASE WHEN n.e < bottom THEN top WHEN n.e - bottom >= 15 THEN n.e WHEN n.e > top OR (bottom = top AND n.e = top) THEN n.e ELSE top END, CASE WHEN n.e < bottom THEN n.e WHEN n.e - bottom >= 15 OR n.e > top OR (bottom = top AND n.e = top) THEN n.e ELSE bottom END,
   runs + (n.e >= bottom AND n.e - bottom >= 15 AND top - bottom >= 30)::INT, fall + CASE WHEN n.e >= bottom AND n.e - bottom >= 15 AND top - bottom >= 30 THEN top - bottom ELSE 0 END FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1)
SELECT k AS o_custkey, runs + (top - bottom >= 30)::INT AS runs, fall + CASE WHEN top - bottom >= 30 THEN top - bottom ELSE 0 END AS fall FROM f WHERE i = (SELECT max(i) FROM n WHERE n.k = f.k)"""
)
def w10_descents(spark, sf_dir):
    """Number and depth of the descents of each series of heights."""
    series = D.ordered_values(table(spark, sf_dir, "orders").withColumn("h", F.round(F.col("o_totalprice") / 5000)), ["o_custkey"], ["o_orderkey"], "h")
    runs = series.select("o_custkey", "values", D.descent_runs(F.col("values")).alias("r"))
    fall = F.aggregate("r", F.lit(0.0), lambda a, r: a + F.get("values", r["top"]) - F.get("values", r["bottom"]))
    return runs.select("o_custkey", F.size("r").alias("runs"), fall.alias("fall"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, count(*) AS n FROM orders GROUP BY 1""")
def a02_best_recording(spark, sf_dir):
    """The best recording of each trail and how many it has; the older one of equals."""
    orders = table(spark, sf_dir, "orders")
    best = A.best_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return best.select("o_custkey", F.col("o_orderkey").alias("best")).join(orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey")
