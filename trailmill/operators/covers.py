"""Covers of areas as ranges of tile numbers, by descent through the quadtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import hilbert_id, in_ring, segment_meets_box
from ..scratch import saved
from .sequences import merged_intervals

#: Where in a cell its side is looked up, as shares of its width: any place serves in a cell without an edge, and these lie on no line between tile corners.
PLACE_X, PLACE_Y = 0.41421356237309503, 0.7320508075688772


def area_ranges(rings: DataFrame, zoom: int) -> DataFrame:
    """area_id, start, end: Hilbert numbers (without the tiles of lower zooms, end exclusive) of all tiles that areas touch or hold.

    ``rings`` (area_id, ring of x and y in tile units of the zoom) are closed lines; of several rings of an area the even-odd rule makes holes. From zoom 0
    on, cells that an edge touches go to their four children with their edges alone; a child without edges is inside or outside as a whole, which
    the edges between its place and its parent's tell, and one inside is one range of numbers. So no tile inside is listed: work follows the border.
    """
    world = float(1 << zoom)
    px, py = F.lit(PLACE_X * world), F.lit(PLACE_Y * world)
    odd = F.pmod(F.sum(in_ring(px, py, F.col("ring")).cast("int")), F.lit(2)) == 1
    sides = rings.groupBy("area_id").agg(odd.alias("inside"))
    closed = F.concat("ring", F.slice("ring", 1, 1))
    each = F.transform(F.sequence(F.lit(1), F.size("ring")), lambda i: F.struct(F.get(closed, i - 1)["x"].cast("double").alias("ax"), F.get(closed, i - 1)["y"].cast("double").alias("ay"), F.get(closed, i)["x"].cast("double").alias("bx"), F.get(closed, i)["y"].cast("double").alias("by")))
    edges = rings.filter("size(ring) > 0").select("area_id", F.inline(each))
    now = saved(edges.join(sides, "area_id").withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")}), "cover")
    found = []
    for level in range(1, zoom + 1):
        told, now = one_level(now, level, world)
        found.append(told)
    last = now.select("area_id", "x", "y").distinct().select("area_id", number(zoom, zoom).alias("start"), (number(zoom, zoom) + 1).alias("end"))
    for told in found:
        last = last.unionByName(told)
    return merged_intervals(last, ["area_id"], "start", "end").select("area_id", "start", "end")


def number(level: int, zoom: int) -> Column:
    """First number at a zoom of a cell (x, y) of a level."""
    before = ((1 << 2 * level) - 1) // 3
    return (hilbert_id(level, F.col("x"), F.col("y")) - before) * (1 << 2 * (zoom - level))


def one_level(now: DataFrame, level: int, world: float) -> tuple[DataFrame, DataFrame]:
    """(ranges of children inside, rows of children with edges) from rows (area_id, x, y, inside, edge) of the cells that edges touch."""
    width = world / (1 << level)
    place = lambda x, share, w: (x + share) * w
    child = F.explode(F.array(*[F.struct((F.col("x") * 2 + dx).alias("cx"), (F.col("y") * 2 + dy).alias("cy")) for dx in (0, 1) for dy in (0, 1)]))
    rows = now.withColumn("c", child)
    px, py = place(F.col("x"), PLACE_X, width * 2), place(F.col("y"), PLACE_Y, width * 2)
    qx, qy = place(F.col("c.cx"), PLACE_X, width), place(F.col("c.cy"), PLACE_Y, width)
    ax, ay, bx, by = (F.col(k) for k in ("ax", "ay", "bx", "by"))
    # from the parent's place upwards or downwards, then sideways to the child's
    at_y, at_x = ay + (px - ax) * (by - ay) / (bx - ax), ax + (qy - ay) * (bx - ax) / (by - ay)
    upright = F.when((ax > px) != (bx > px), ((at_y > py) != (at_y > qy)).cast("int")).otherwise(0)
    level_leg = F.when((ay > qy) != (by > qy), ((at_x > px) != (at_x > qx)).cast("int")).otherwise(0)
    x0, y0 = F.col("c.cx") * width, F.col("c.cy") * width
    edge = F.struct(F.struct(ax.alias("x"), ay.alias("y")).alias("a"), F.struct(bx.alias("x"), by.alias("y")).alias("b"))
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + width).alias("y1"))
    # a place on the line between two cells is in the right or lower one
    within = (F.least(ax, bx) < x0 + width) & (F.least(ay, by) < y0 + width)
    rows = rows.withColumns({"crossed": upright + level_leg, "touched": segment_meets_box(edge, box) & within})
    told = rows.groupBy("area_id", "c").agg((F.pmod(F.sum("crossed"), F.lit(2)) == 1).alias("odd"), F.bool_or("touched").alias("touched"), F.first("inside").alias("before"))
    told = saved(told.select("area_id", "c", (F.col("before") != F.col("odd")).alias("side"), F.col("touched").alias("border")), "cover")
    zoom = int(world).bit_length() - 1
    whole = told.filter("side and not border").select("area_id", F.col("c.cx").alias("x"), F.col("c.cy").alias("y"))
    ranges = whole.select("area_id", number(level, zoom).alias("start"), (number(level, zoom) + (1 << 2 * (zoom - level))).alias("end"))
    on = rows.filter("touched").select("area_id", "c", "ax", "ay", "bx", "by").join(told.filter("border").select("area_id", "c", "side"), ["area_id", "c"])
    return ranges, saved(on.select("area_id", "ax", "ay", "bx", "by", F.col("side").alias("inside"), F.col("c.cx").alias("x"), F.col("c.cy").alias("y")), "cover")


def ranges_at(ranges: DataFrame, zoom: int, other: int) -> DataFrame:
    """Ranges (area_id, start, end) of a zoom as those of another one: all descendants, or the ancestors that hold them."""
    if other >= zoom:
        k = 1 << 2 * (other - zoom)
        return ranges.select("area_id", (F.col("start") * k).alias("start"), (F.col("end") * k).alias("end"))
    k = 1 << 2 * (zoom - other)
    up = ranges.select("area_id", F.floor(F.col("start") / k).cast("long").alias("start"), (F.floor((F.col("end") - 1) / k) + 1).cast("long").alias("end"))
    return merged_intervals(up, ["area_id"], "start", "end").select("area_id", "start", "end")
