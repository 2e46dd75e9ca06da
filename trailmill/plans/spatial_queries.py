"""Geometry and range joins over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import spatial as P
from .catalog import query, table

PLACES = "pl AS (SELECT c_custkey AS id, c_acctbal / 200.0 AS lat, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon FROM customer)"


def places(spark, sf_dir):
    """Customers as places on the globe."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 200.0).alias("lat"), (F.pmod(F.col("c_custkey") * 37, F.lit(3600)) / 10.0 - 180).alias("lon"))


def vectors(spark, sf_dir):
    """Embeddings as polylines of 32 points."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_id"), pairs.alias("points"))


@query(
    f"""WITH {PLACES} SELECT a.id, round(2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) / 1000, 3) AS km
FROM pl a JOIN pl b ON b.id = a.id + 1"""
)
def g01_haversine(spark, sf_dir):
    """Distance of each place from the next one."""
    a, b = places(spark, sf_dir), places(spark, sf_dir).select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "id").select("id", F.round(G.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / 1000, 3).alias("km"))


@query(
    f"""WITH {PLACES}, d AS (SELECT a.id, (degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 720) % 360 AS deg FROM pl a JOIN pl b ON b.id = a.id + 1)
SELECT id, round(deg, 3) AS degrees, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor((deg + 22.5) / 45)::INT % 8) + 1] AS point FROM d"""
)
def g02_bearing(spark, sf_dir):
    """Bearing and compass point from each place to the next one."""
    a, b = places(spark, sf_dir), places(spark, sf_dir).select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    degrees = G.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return a.join(b, "id").select("id", F.round(degrees, 3).alias("degrees"), G.compass_point(degrees).alias("point"))


@query(
    f"""WITH {PLACES} SELECT id, least(greatest(floor((lon + 180) / 360 * 4096), 0), 4095)::INT AS x, least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096), 0), 4095)::INT AS y,
  floor(lat / 0.1)::BIGINT || '_' || floor(lon / 0.15)::BIGINT AS cell, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(floor((lon + 180) / 6) + 1, 60))::INT AS utm FROM pl"""
)
def g23_tiles(spark, sf_dir):
    """Tile, grid cell and UTM zone of each place."""
    lat, lon = F.col("lat"), F.col("lon")
    return places(spark, sf_dir).select("id", G.tile_x(lon, 12).alias("x"), G.tile_y(lat, 12).alias("y"), G.grid_cell(lat, lon).alias("cell"), G.utm_zone(lat, lon).alias("utm"))


@query(
    """SELECT vec_id AS line_id, round(list_sum(list_transform(range(1, 32), lambda i: sqrt(pow(embedding[2 * i + 1]::DOUBLE - embedding[2 * i - 1]::DOUBLE, 2) + pow(embedding[2 * i + 2]::DOUBLE - embedding[2 * i]::DOUBLE, 2)))), 5) AS long FROM embeddings"""
)
def g05_length(spark, sf_dir):
    """Length of each polyline."""
    return vectors(spark, sf_dir).select("line_id", F.round(G.line_length(F.col("points")), 5).alias("long"))


@query(
    """WITH l AS (SELECT vec_id AS line_id, list_sum(list_transform(range(1, 32), lambda i: sqrt(pow(embedding[2 * i + 1]::DOUBLE - embedding[2 * i - 1]::DOUBLE, 2) + pow(embedding[2 * i + 2]::DOUBLE - embedding[2 * i]::DOUBLE, 2)))) AS long FROM embeddings)
SELECT line_id, 2 + floor(long / 0.05)::INT AS n FROM l"""
)
def g06_resampled(spark, sf_dir):
    """How many points each polyline has when resampled."""
    return vectors(spark, sf_dir).select("line_id", F.size(G.resampled(F.col("points"), 0.05)).alias("n"))


@query(
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT a.vec_id, count(*) AS near FROM p a JOIN p b ON a.vec_id <> b.vec_id AND abs(a.x - b.x) <= 0.02 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02 GROUP BY 1"""
)
def j02_cell_join(spark, sf_dir):
    """Neighbours within a distance, by grid cells."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    others = points.select(F.col("vec_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return P.within(points, others, 0.02).filter("vec_id <> other_id").groupBy("vec_id").agg(F.count("*").alias("near"))


@query(
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)
SELECT vec_id, arg_min(other, d)::BIGINT AS nearest FROM (SELECT a.vec_id, b.vec_id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON b.label = 0 AND a.label <> 0 AND abs(a.x - b.x) <= 0.05) WHERE d <= 0.05 GROUP BY 1"""
)
def j38_nearest(spark, sf_dir):
    """The nearest point of another set within a distance."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    others = points.filter("label = 0").select(F.col("vec_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = P.within(points.filter("label <> 0").drop("label"), others, 0.05)
    return P.nearest(near, ["vec_id"], "d", ["other_id"]).select("vec_id", F.col("other_id").alias("nearest"))


@query(
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS ax, embedding[4]::DOUBLE AS ay, embedding[5]::DOUBLE AS bx, embedding[6]::DOUBLE AS b_y FROM embeddings),
t AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) AS t FROM p)
SELECT vec_id, round(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (b_y - ay), 2)), 6) AS d FROM t"""
)
def g07_point_segment(spark, sf_dir):
    """Distance of a point from a segment."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(G.point_segment(e(0), e(1), e(2), e(3), e(4), e(5))["d"], 6).alias("d"))


@query(
    """SELECT vec_id AS line_id FROM embeddings WHERE len(list_filter(range(32), lambda i: embedding[2 * i + 1] > -0.1 AND embedding[2 * i + 1] < 0.1 AND embedding[2 * i + 2] > -0.1 AND embedding[2 * i + 2] < 0.1)) * 2 > 32"""
)
def f11_in_ring(spark, sf_dir):
    """Lines that lie mostly in a ring."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1))])
    return vectors(spark, sf_dir).filter(G.mostly_in_ring(F.col("points"), ring)).select("line_id")


@query(
    """WITH l AS (SELECT vec_id, list_transform(range(32), lambda i: [embedding[2 * i + 1]::DOUBLE, embedding[2 * i + 2]::DOUBLE]) AS p FROM embeddings)
SELECT a.vec_id AS line_id, round(list_reduce(list_prepend([]::DOUBLE[], a.p), lambda before, p: list_reduce(list_prepend([]::DOUBLE[], b.p), lambda row, q: list_append(row, greatest(sqrt(pow(p[1] - q[1], 2) + pow(p[2] - q[2], 2)),
  least(CASE WHEN len(before) = 0 AND len(row) = 0 THEN 0 END, before[len(row) + 1], CASE WHEN len(row) > 0 THEN before[len(row)] END, CASE WHEN len(row) > 0 THEN row[len(row)] END)))))[32], 6) AS frechet FROM l a JOIN l b ON b.vec_id = a.vec_id + 1"""
)
def g09_frechet(spark, sf_dir):
    """Discrete Fréchet distance of each polyline from the next one."""
    from ..functions.folds import frechet

    a = vectors(spark, sf_dir)
    b = a.select((F.col("line_id") - 1).alias("line_id"), F.col("points").alias("next"))
    return a.join(b, "line_id").select("line_id", F.round(frechet(F.col("points"), F.col("next")), 6).alias("frechet"))


@query(
    """WITH pt AS (SELECT vec_id AS id, i, embedding[2 * i + 1]::DOUBLE * 1000 + (vec_id // 5) * 3000.0 AS x, embedding[2 * i + 2]::DOUBLE * 1000 AS y FROM embeddings, range(32) t(i)), s0 AS (SELECT id, i, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM pt WINDOW w AS (PARTITION BY id ORDER BY i)),
sg AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)) AS own FROM s0 WHERE bx IS NOT NULL), st AS (SELECT *, coalesce(sum(own) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(own) OVER (PARTITION BY id) AS total FROM sg),
sm AS (SELECT id, k * 100.0 AS pos, ax + (bx - ax) * (k * 100 - start) / own AS x, ay + (b_y - ay) * (k * 100 - start) / own AS y FROM st, range(1, 2000) t(k) WHERE k > floor(start / 100) AND k <= floor((start + own) / 100) UNION ALL SELECT id, 0, x, y FROM pt WHERE i = 0 UNION ALL SELECT id, 1e9, x, y FROM pt WHERE i = 31),
nr AS (SELECT m.id, m.pos, s.id AS other, s.start, s.own, s.total, greatest(0, least(1, ((m.x - ax) * (bx - ax) + (m.y - ay) * (b_y - ay)) / (own * own))) AS t, m.x, m.y, ax, ay, bx, b_y FROM sm m JOIN st s ON m.id <> s.id AND m.x >= least(ax, bx) - 15 AND m.x <= greatest(ax, bx) + 15 AND m.y >= least(ay, b_y) - 15 AND m.y <= greatest(ay, b_y) + 15),
d AS (SELECT id, pos, other, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (b_y - ay), 2)) AS d, (start + t * own) / total AS f FROM nr), b AS (SELECT id, pos, other, arg_min(f, d) AS f FROM d WHERE d <= 15 GROUP BY 1, 2, 3), h AS (SELECT *, f - lag(f) OVER (PARTITION BY id, other ORDER BY pos) AS ahead FROM b)
SELECT h.id AS line_id, other AS other_id, round(count(*) / any_value(n), 6) AS cov, CASE WHEN count(ahead) < 3 THEN 'mixed' WHEN count_if(ahead > 0) / count(ahead) >= 0.7 THEN 'same' WHEN count_if(ahead > 0) / count(ahead) <= 0.3 THEN 'reversed' ELSE 'mixed' END AS direction
FROM h JOIN (SELECT id, count(*) AS n FROM sm GROUP BY 1) c ON c.id = h.id GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.15"""
)
def g10_matched(spark, sf_dir):
    """How much of each polyline runs near each other one, and in which direction, over all their points; five lie in each place."""
    from ..operators.matching import coverages

    scaled = F.transform("points", lambda p: F.struct((p["x"] * 1000 + F.floor(F.col("line_id") / 5) * 3000.0).alias("x"), (p["y"] * 1000).alias("y")))
    found = coverages(vectors(spark, sf_dir).select("line_id", scaled.alias("points")), 15.0, 100.0)
    return found.filter("cov >= 0.15").select("line_id", "other_id", F.round("cov", 6).alias("cov"), "direction")
