"""Graphs kept as pieces by tile: what a planning frame needs, what is fresh, and reading only its tiles.

A store is a table partitioned by tile, so a frame's tiles decide at run time which folders are read. Versions are small tables of (tile, version).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_pieces(edges: DataFrame, path: str) -> None:
    """Write edges (tile, ...) as a store; tiles lie together, and one that holds far more than others is split over tasks."""
    edges.hint("rebalance", "tile").write.partitionBy("tile").parquet(path)


def versions(edges: DataFrame, version: str) -> DataFrame:
    """tile, version: the newest version of each tile of edges."""
    return edges.groupBy("tile").agg(F.max(version).alias("version"))


def frame_tiles(frames: DataFrame, wide: int, most_tiles: int) -> DataFrame:
    """frame_id, tile of frames (frame_id, x0, y0, x1, y1, in tiles, ends included); a frame of more than most_tiles is too large and has none."""
    fits = frames.filter((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) <= most_tiles)
    columns = fits.withColumn("x", F.explode(F.sequence("x0", "x1")))
    return columns.withColumn("y", F.explode(F.sequence("y0", "y1"))).select("frame_id", (F.col("y") * wide + F.col("x")).alias("tile"))


def planned(needed: DataFrame, kept: DataFrame, published: DataFrame, most_online: int) -> DataFrame:
    """frame_id, tile, action of needed (frame_id, tile), from the versions kept and published.

    A kept piece is read, unless a newer one is published: then it is refreshed, before missing pieces are filled, in the order of tiles and at most
    most_online of both together for a frame. Beyond that an old piece is used as it is (``old``) and a missing one stays missing (``left``);
    ``none`` is neither kept nor published.
    """
    known = needed.join(kept.toDF("tile", "__kept"), "tile", "left").join(published.toDF("tile", "__out"), "tile", "left")
    stale, missing = F.coalesce(F.col("__kept") < F.col("__out"), F.lit(False)), F.col("__kept").isNull() & F.col("__out").isNotNull()
    marked = known.withColumns({"__stale": stale, "__missing": missing})
    # a frame has at most most_tiles rows
    place = F.row_number().over(W.partitionBy("frame_id").orderBy(F.desc("__stale"), F.desc("__missing"), "tile"))
    online = place <= most_online
    action = (
        F.when(F.col("__stale"), F.when(online, "refresh").otherwise("old"))
        .when(F.col("__missing"), F.when(online, "fill").otherwise("left"))
        .when(F.col("__kept").isNull(), "none")
        .otherwise("read")
    )
    return marked.select("frame_id", "tile", action.alias("action"))


def frame_edges(spark: SparkSession, plan: DataFrame, store: str, source: str) -> DataFrame:
    """frame_id and the edges of its tiles: kept pieces from the store, refreshed and filled ones from the published source.

    Both are joined by their partition column, so where the plan is small enough to be broadcast, Spark reads only the folders of its tiles.
    """
    parts = []
    for path, actions in ((store, ("read", "old")), (source, ("refresh", "fill"))):
        parts.append(spark.read.parquet(path).join(plan.filter(F.col("action").isin(*actions)).select("frame_id", "tile"), "tile"))
    return parts[0].unionByName(parts[1])
