"""Rasters in tiles over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mosaics as M
from .catalog import query, table

SIDE = 8

# A tile for each part, 40 to a row; some heights are unknown, and some tiles know none.
GRID = """v AS (SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, i % 9 AS c, i // 9 AS r, CASE WHEN p_size % 9 <> 4 AND (p_partkey + i * p_size) % 11 <> 3 THEN (p_partkey * 37 + i * p_size) % 900 END AS h FROM part, range(81) t(i)),
g AS (SELECT x * 8 + c AS gx, y * 8 + r AS gy, arg_min(h, (c = 8)::INT * 2 + (r = 8)::INT) AS height FROM v WHERE h IS NOT NULL GROUP BY 1, 2)"""


def height_tiles(spark, sf_dir):
    """x, y, heights of a tile for each part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    value = lambda i: F.when((size % 9 != 4) & ((k + i * size) % 11 != 3), (k * 37 + i * size) % 900)
    return table(spark, sf_dir, "part").select((k % 40).alias("x"), F.floor(k / 40).alias("y"), F.transform(F.sequence(F.lit(0), F.lit(80)), value).alias("heights"))


@query(f"WITH {GRID} SELECT a.gx, a.gy, any_value(a.height)::BIGINT AS block, round(avg(b.height), 6) AS smooth FROM g a JOIN (SELECT gx + dx AS gx, gy + dy AS gy, height FROM g, (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) q(dy)) b ON a.gx = b.gx AND a.gy = b.gy GROUP BY 1, 2")
def g38_mosaic(spark, sf_dir):
    """Tiles read as one raster, with the mean around each sample across the borders of tiles."""
    found = M.samples(M.smoothed(M.mosaic(height_tiles(spark, sf_dir), SIDE), SIDE), SIDE)
    return found.select("gx", "gy", F.col("block").cast("long").alias("block"), F.round("smooth", 6).alias("smooth"))


@query(f"WITH {GRID} SELECT gx // 4 AS column, gy // 4 AS row, height::BIGINT AS height FROM g WHERE gx % 4 = 0 AND gy % 4 = 0")
def g38_thinned(spark, sf_dir):
    """Every fourth sample of the whole raster in both directions."""
    found = M.samples(M.mosaic(height_tiles(spark, sf_dir), SIDE), SIDE, 4)
    return found.select(F.floor(F.col("gx") / 4).alias("column"), F.floor(F.col("gy") / 4).alias("row"), F.col("block").cast("long").alias("height"))
