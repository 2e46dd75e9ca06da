"""Range joins of points by grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within(points: DataFrame, others: DataFrame, reach: float) -> DataFrame:
    """Pairs of points (x, y) and others (ox, oy) at most ``reach`` apart, with their distance d.

    The others go to their own cell and its eight neighbours, so that each pair meets in exactly one cell.
    """
    cell = lambda v: F.floor(F.col(v) / reach)
    a = points.withColumns({"__cx": cell("x"), "__cy": cell("y")})
    around = lambda v: F.explode(F.sequence(cell(v) - 1, cell(v) + 1))
    b = others.withColumn("__cx", around("ox")).withColumn("__cy", around("oy"))
    d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
    return a.join(b, ["__cx", "__cy"]).withColumn("d", d).filter(F.col("d") <= reach).drop("__cx", "__cy")


def nearest(pairs: DataFrame, keys: Sequence[str], d: str, tie: Sequence[str]) -> DataFrame:
    """The pair of least distance for each key, ties by further columns."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(d, *tie))
    return pairs.withColumn("__at", at).filter("__at = 1").drop("__at")


def hides_others(mine: DataFrame, others: DataFrame, reach: float) -> DataFrame:
    """Others (other_id, ox, oy) that no own point (x, y) is within reach of."""
    hidden = within(mine, others, reach).select("other_id").distinct()
    return others.join(hidden, "other_id", "left_anti")


def covered_by_tiles(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted tiles that are not stored; empty if an area is covered."""
    return wanted.select(*keys).distinct().join(stored.select(*keys), list(keys), "left_anti")


def tiles_along(lines: DataFrame, zoom: int, margin_deg: float = 0.0) -> DataFrame:
    """line_id, x, y: tiles that the box of each segment touches, widened by a margin."""
    from ..functions.geo import segments, tiles_of_box

    s = lines.select("line_id", F.explode(segments(F.col("points"))).alias("s")).select("line_id", "s.a.lat", "s.a.lon", F.col("s.b.lat").alias("lat2"), F.col("s.b.lon").alias("lon2"))
    box = tiles_of_box(F.least("lat", "lat2") - margin_deg, F.least("lon", "lon2") - margin_deg, F.greatest("lat", "lat2") + margin_deg, F.greatest("lon", "lon2") + margin_deg, zoom)
    return s.select("line_id", F.explode(box).alias("t")).select("line_id", "t.x", "t.y").distinct()


def tile_rectangles(tiles: DataFrame) -> DataFrame:
    """x0, x1, y0, y1: rows of neighbouring tiles, joined downwards where rows have the same run."""
    row = F.row_number().over(W.partitionBy("y").orderBy("x"))
    runs = tiles.select("x", "y").distinct().withColumn("__b", F.col("x") - row).groupBy("y", "__b").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    down = F.row_number().over(W.partitionBy("x0", "x1").orderBy("y"))
    return runs.withColumn("__c", F.col("y") - down).groupBy("x0", "x1", "__c").agg(F.min("y").alias("y0"), F.max("y").alias("y1")).drop("__c")
