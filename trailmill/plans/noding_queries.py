"""Planar road graphs and trails laid on them over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import noding as N
from .catalog import query, table
from .network_queries import CROSS, SAMPLES, slants, strips

# Roads run upwards, one for each part; trails are level and longer than the strips, one for each part as well.
ROADS = "rd AS (SELECT p_partkey AS id, (p_partkey * 13 % 300) + 0.5 AS x, (p_partkey // 20) * 6.0 - p_size AS y0, (p_partkey // 20) * 6.0 + p_size % 11 + 1 AS y1 FROM part)"
TRAILS = "tr AS (SELECT p_partkey AS id, (p_partkey * 29 % 20) * 9.0 AS x0, (p_partkey * 29 % 20) * 9.0 + 120 AS x1, (p_partkey // 27) * 6.0 + p_partkey % 2 AS y, p_partkey % 3 = 0 AS back, ['downhill', 'uphill', 'connector'][p_size % 3 + 1] AS role, p_size % 4 = 0 AS two_way FROM part)"


def roads(spark, sf_dir):
    """line_id and the two points of each road."""
    k, size = F.col("p_partkey"), F.col("p_size")
    at = lambda y: F.struct(((k * 13 % 300) + 0.5).alias("x"), y.cast("double").alias("y"))
    base = F.floor(k / 20) * 6.0
    return table(spark, sf_dir, "part").select(k.alias("line_id"), F.array(at(base - size), at(base + size % 11 + 1)).alias("points"))


def laid_trails(spark, sf_dir):
    """line_id, points, role, two_way of each trail."""
    k, size = F.col("p_partkey"), F.col("p_size")
    x0, y = (k * 29 % 20) * 9.0, F.floor(k / 27) * 6.0 + k % 2
    at = lambda x: F.struct(x.alias("x"), y.alias("y"))
    points = F.when(k % 3 == 0, F.array(at(x0 + 120), at(x0))).otherwise(F.array(at(x0), at(x0 + 120)))
    role = F.get(F.array(*map(F.lit, ("downhill", "uphill", "connector"))), size % 3)
    return table(spark, sf_dir, "part").select(k.alias("line_id"), points.alias("points"), role.alias("role"), (size % 4 == 0).alias("two_way"))


@query(
    f"""WITH {CROSS}, m AS (SELECT a.id AS a, b.id AS b, a.ax, a.ay, a.bx - a.ax AS rx, a.b_y - a.ay AS ry, b.ax - a.ax AS qx, b.ay - a.ay AS qy, b.bx - b.ax AS sx, b.b_y - b.ay AS sy FROM cr a JOIN cr b ON a.id < b.id AND a.level = b.level AND a.ay <= b.b_y AND b.ay <= a.b_y),
t AS (SELECT *, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS u FROM m WHERE abs(rx * sy - ry * sx) >= 1e-9),
h AS (SELECT a, b, t, u, ax + t * rx AS x, ay + t * ry AS y FROM t WHERE t > 0.001 AND t < 0.999 AND u > 0.001 AND u < 0.999),
v AS (SELECT a AS id, t AS place, x, y FROM h UNION ALL SELECT b, u, x, y FROM h UNION ALL SELECT id, 0, ax, ay FROM cr UNION ALL SELECT id, 1, bx, b_y FROM cr),
n AS (SELECT *, floor(x * 1000 + 0.5)::BIGINT || ',' || floor(y * 1000 + 0.5)::BIGINT AS node FROM v),
k AS (SELECT * FROM (SELECT *, lag(node) OVER (PARTITION BY id ORDER BY place, node) AS before FROM n) WHERE before IS NULL OR before <> node),
p AS (SELECT id, lag(node) OVER w AS a, node AS b, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS long, row_number() OVER w - 2 AS part FROM k WINDOW w AS (PARTITION BY id ORDER BY place, node))
SELECT id AS line_id, part, a, b, round(long, 6) AS length FROM p WHERE part >= 0"""
)
def r03_noded(spark, sf_dir):
    """The planar graph of slanting lines on two levels: pieces between crossings with their nodes."""
    found = N.noded(slants(spark, sf_dir), reach=0.0)
    return found.select("line_id", F.col("part").cast("long").alias("part"), "a", "b", F.round("length", 6).alias("length"))


@query(
    f"""WITH {SAMPLES}, {TRAILS}, n AS (SELECT s.id, t.id AS other, count(*) AS n FROM sm s JOIN (SELECT *, unnest([floor(y / 15) - 1, floor(y / 15), floor(y / 15) + 1]) AS band FROM tr) t ON floor(s.y / 15) = t.band AND sqrt(pow(greatest(t.x0 - s.x, s.x - t.x1, 0), 2) + pow(s.y - t.y, 2)) <= 15 GROUP BY 1, 2),
z AS (SELECT id, count(*) AS total FROM sm GROUP BY 1),
b AS (SELECT n.id, other, n / total AS share FROM n JOIN z USING (id) WHERE n / total >= 0.8 QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY n / total DESC, other) = 1),
w AS (SELECT b.*, t.role, t.two_way, (CASE WHEN t.back THEN -1 ELSE 1 END) * (CASE WHEN st.back THEN -1 ELSE 1 END) * (greatest(t.x0, least(t.x1, st.x1)) - greatest(t.x0, least(t.x1, st.x0))) AS way FROM b JOIN tr t ON t.id = other JOIN st ON st.id = b.id)
SELECT id AS line_id, other AS trail_id, round(share, 6) AS share, role <> 'downhill' AS connector, CASE WHEN role = 'connector' OR two_way OR abs(way) < 5 THEN NULL WHEN way > 0 THEN 'backward' ELSE 'forward' END AS blocked FROM w"""
)
def r08_overlaid(spark, sf_dir):
    """Edges that lie on trails, and the direction that a trail blocks on them."""
    return N.overlaid(strips(spark, sf_dir), laid_trails(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(
    f"""WITH RECURSIVE {SAMPLES}, {ROADS}, h AS (SELECT s.id, s.pos, min({{'d': round(sqrt(pow(s.x - r.x, 2) + pow(greatest(r.y0 - s.y, s.y - r.y1, 0), 2)), 6), 'e': r.id}}) AS h FROM sm s JOIN (SELECT *, unnest([floor(x / 15) - 1, floor(x / 15), floor(x / 15) + 1]) AS band FROM rd) r ON floor(s.x / 15) = r.band AND s.y BETWEEN r.y0 - 15 AND r.y1 + 15 AND sqrt(pow(s.x - r.x, 2) + pow(greatest(r.y0 - s.y, s.y - r.y1, 0), 2)) <= 15 GROUP BY 1, 2),
g AS (SELECT sm.id, sm.pos, h.h.d AS d, h.h.e AS e, lag(h.h.d) OVER w AS db, lag(h.h.e) OVER w AS eb, lead(h.h.d) OVER w AS da, count(*) OVER (PARTITION BY sm.id) AS n FROM sm LEFT JOIN h ON h.id = sm.id AND h.pos = sm.pos WINDOW w AS (PARTITION BY sm.id ORDER BY sm.pos)),
w AS (SELECT id, pos, pos * 5.0 AS m, d, e, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM g WHERE d IS NOT NULL AND pos * 5 >= 30 AND (n - 1 - pos) * 5 >= 30 AND ((pos BETWEEN 1 AND n - 2 AND (db IS NULL OR eb <> e OR d <= 5 AND d <= coalesce(db, d) AND d <= coalesce(da, d))) OR (pos <= n - 3 AND da IS NULL))),
r AS (SELECT id, i, pos, m, d, e, 1 AS k FROM w WHERE i = 1 UNION ALL SELECT w.id, w.i, CASE WHEN w.m - r.m >= 15 OR w.d < r.d THEN w.pos ELSE r.pos END, CASE WHEN w.m - r.m >= 15 OR w.d < r.d THEN w.m ELSE r.m END, CASE WHEN w.m - r.m >= 15 OR w.d < r.d THEN w.d ELSE r.d END, CASE WHEN w.m - r.m >= 15 OR w.d < r.d THEN w.e ELSE r.e END, r.k + (w.m - r.m >= 15)::INT FROM r JOIN w ON w.id = r.id AND w.i = r.i + 1)
SELECT id AS line_id, pos, m::DOUBLE AS m, round(d, 6) AS d, e AS other_id FROM r QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY i DESC) = 1"""
)
def r08_junctions(spark, sf_dir):
    """Where connectors are joined to the roads on their way."""
    found = N.junctions(roads(spark, sf_dir), strips(spark, sf_dir))
    return found.select("line_id", F.col("pos").cast("long").alias("pos"), "m", F.round("d", 6).alias("d"), "other_id")
