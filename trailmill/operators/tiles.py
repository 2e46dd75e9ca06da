"""Tile sets and archives as tables: covers, run-length directories, differences, evictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import in_ring, segment_meets_box, segments
from .groups import in_order_of_all


def ring_tiles(rings: DataFrame) -> DataFrame:
    """area_id, x, y of all tiles that rings (area_id, ring of x and y in tile units) touch or hold.

    The tiles of a ring's box are dealt out, by columns of tiles to different tasks, and each is tested by itself: its centre
    inside, or an edge through it.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    low = lambda v: F.floor(F.array_min(v)).cast("int")
    high = lambda v: F.floor(F.array_max(v)).cast("int")
    boxes = rings.select("area_id", "ring", low(xs).alias("x0"), high(xs).alias("x1"), low(ys).alias("y0"), high(ys).alias("y1"))
    columns = boxes.withColumn("x", F.explode(F.sequence("x0", "x1"))).repartition("area_id", "x")
    tiles = columns.withColumn("y", F.explode(F.sequence("y0", "y1")))
    box = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1).alias("x1"), (F.col("y") + 1).alias("y1"))
    closed = F.concat("ring", F.slice("ring", 1, 1))
    touched = F.exists(segments(closed), lambda s: segment_meets_box(s, box))
    return tiles.filter(touched | in_ring(F.col("x") + 0.5, F.col("y") + 0.5, F.col("ring"))).select("area_id", "x", "y")


def directory_runs(tiles: DataFrame) -> DataFrame:
    """tile_id, run_length, content: neighbouring tiles of equal content as one entry, from (tile_id, content)."""
    size = 1 << 20  # runs are found in blocks of a million ids, then joined where two blocks meet
    block = F.floor(F.col("tile_id") / size)
    over = W.partitionBy(block).orderBy("tile_id")
    new = ~((F.col("tile_id") == F.lag("tile_id").over(over) + 1) & (F.col("content") == F.lag("content").over(over)))
    marked = tiles.withColumn("__block", block).withColumn("__new", F.coalesce(new, F.lit(True)).cast("int"))
    numbered = marked.withColumn("__run", F.sum("__new").over(over.rowsBetween(W.unboundedPreceding, 0)))
    runs = numbered.groupBy("__block", "__run").agg(F.min("tile_id").alias("tile_id"), F.count("*").alias("run_length"), F.first("content").alias("content")).drop("__block", "__run")
    first, end = F.pmod("tile_id", F.lit(size)) == 0, F.col("tile_id") + F.col("run_length")
    at_edge = first | (F.pmod(end, F.lit(size)) == 0)
    along = W.orderBy("tile_id")  # at most two runs of each block
    goes_on = first & (F.lag(end).over(along) == F.col("tile_id")) & (F.lag("content").over(along) == F.col("content"))
    edges = runs.filter(at_edge).withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    joined = edges.withColumn("__run", F.sum("__new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    whole = joined.groupBy("__run").agg(F.min("tile_id").alias("tile_id"), F.sum("run_length").alias("run_length"), F.first("content").alias("content")).drop("__run")
    return runs.filter(~at_edge).unionByName(whole)


def addressed(directory: DataFrame) -> DataFrame:
    """One row: tiles that a directory addresses, its entries and its distinct contents."""
    return directory.agg(F.sum("run_length").alias("addressed"), F.count("*").alias("entries"), F.count_distinct("content").alias("contents"))


def archive_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """z, state, n, bytes of two archives (tile_id, z, length, etag): added, removed, same, same-length, other-length."""
    a = old.select("tile_id", F.col("z").alias("za"), F.col("length").alias("la"), F.col("etag").alias("ea"))
    b = new.select("tile_id", F.col("z").alias("zb"), F.col("length").alias("lb"), F.col("etag").alias("eb"))
    state = F.when(F.col("za").isNull(), "added").when(F.col("zb").isNull(), "removed").when(F.col("ea") == F.col("eb"), "same").when(F.col("la") == F.col("lb"), "same-length").otherwise("other-length")
    return a.join(b, "tile_id", "full_outer").groupBy(F.coalesce("za", "zb").alias("z"), state.alias("state")).agg(F.count("*").alias("n"), F.sum(F.coalesce("lb", F.lit(0))).alias("bytes"))


def changed_share(sample: DataFrame, strata: DataFrame) -> DataFrame:
    """z, third, estimated: changed tiles of each stratum, from a sample (z, third, changed) and all sizes (z, third, n)."""
    rates = sample.groupBy("z", "third").agg(F.avg(F.col("changed").cast("int")).alias("rate"))
    return strata.join(rates, ["z", "third"], "left").select("z", "third", (F.col("n") * F.coalesce("rate", F.lit(0.0))).alias("estimated"))


def size_thirds(tiles: DataFrame) -> DataFrame:
    """Tiles with ``third`` (1 to 3) by length within their zoom, cut at exact percentiles."""
    cuts = tiles.groupBy("z").agg(F.percentile("length", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__cuts"))
    third = F.when(F.col("length") <= F.col("__cuts")[0], 1).when(F.col("length") <= F.col("__cuts")[1], 2).otherwise(3)
    return tiles.join(F.broadcast(cuts), "z").withColumn("third", third).drop("__cuts")  # a row for each zoom


def sampled_tiles(tiles: DataFrame, each: int, seed: int = 7) -> DataFrame:
    """A fixed number of tiles of each zoom: the corners of its extent first, then those of least hash."""
    over = W.partitionBy("z")
    corner = (F.col("x").isin(F.lit(-1)) | (F.col("x") == F.min("x").over(over)) | (F.col("x") == F.max("x").over(over))) & ((F.col("y") == F.min("y").over(over)) | (F.col("y") == F.max("y").over(over)))
    order = F.row_number().over(over.orderBy(F.desc("__corner"), F.xxhash64("z", "x", "y", F.lit(seed)), "x", "y"))
    return tiles.withColumn("__corner", corner).withColumn("__at", order).filter(F.col("__at") <= each).drop("__corner", "__at")


def orphans_after(references: DataFrame, removed: DataFrame) -> DataFrame:
    """Tiles that no area refers to once some areas are gone: references (area_id, tile_id), removed (area_id)."""
    gone = references.join(removed, "area_id", "left_semi").select("tile_id").distinct()
    left = references.join(removed, "area_id", "left_anti").select("tile_id").distinct()
    return gone.join(left, "tile_id", "left_anti")


def trimmed_areas(references: DataFrame, cut: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references left, orphaned tiles) after cutting tiles out of areas; areas kept whole are not touched."""
    free = references.join(whole, "area_id", "left_anti")
    lost = free.join(cut.select("tile_id").distinct(), "tile_id", "left_semi").select("area_id", "tile_id")
    left = references.join(lost, ["area_id", "tile_id"], "left_anti")
    return left, lost.select("tile_id").distinct().join(left.select("tile_id"), "tile_id", "left_anti")


def evictions(seen: DataFrame, cap_bytes: int, share: float = 0.9) -> DataFrame:
    """Tiles (tile_id, bytes, touched_at) to evict, least recently used first, once the cap is passed, down to a share of it."""
    marked = in_order_of_all(seen, [F.desc("touched_at"), F.asc("tile_id")], "bytes").crossJoin(seen.agg(F.sum("bytes").alias("__all")))
    return marked.filter((F.col("__all") > cap_bytes) & (F.col("__upto") > cap_bytes * share)).drop("__upto", "__place", "__all")


def way_statistics(ways: DataFrame, length: Column) -> DataFrame:
    """highway, tag, value, cell, km: lengths of tagged ways, mergeable by summing again."""
    tags = ways.select("highway", "cell", length.alias("m"), F.explode("tags").alias("tag", "value"))
    return tags.groupBy("highway", "tag", "value", "cell").agg((F.sum("m") / 1000).alias("km"))
