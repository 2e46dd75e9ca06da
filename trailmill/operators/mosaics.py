"""Rasters in tiles read as one raster: tiles send their borders to their neighbours once.

A tile of ``side`` steps has (side + 1)² heights, row by row from the north-west, so that a border belongs to both tiles. A block holds the side² samples
that a tile owns: all but its last row and column. Each border goes to the neighbour's key, so one shuffle of tiles and strips is all there is; no
task holds more than a tile and its strips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def met(tiles: DataFrame, strips: list[tuple[str, Column, int, int]]) -> DataFrame:
    """x, y, strips: by name what each place gets from its neighbours; (name, heights, dx, dy) goes dx columns east and dy rows south. Tiles are read once."""
    sent = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(name).alias("name"), heights.alias("heights")) for name, heights, dx, dy in strips))
    rows = tiles.select(F.explode(sent).alias("s")).select("s.*")
    # at most nine strips of a tile meet
    return rows.groupBy("x", "y").agg(F.map_from_entries(F.collect_list(F.struct("name", "heights"))).alias("strips"))


def mosaic(tiles: DataFrame, side: int) -> DataFrame:
    """x, y, block of tiles (x, y, heights): the samples that each place owns, null where no tile knows a height.

    A sample on a border is read from its own tile, else from the northern, the western and the north-western neighbour. A place without a tile has a
    block too if a neighbour's border reaches it. Tiles are unique by (x, y); heights that are missing or null are unknown; an empty table gives none.
    """
    h, wide = F.col("heights"), side + 1
    last_row = F.slice(h, side * wide + 1, side)
    last_column = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.get(h, r * wide + side))
    corner = F.array(F.get(h, F.lit(wide * wide - 1)))
    found = met(tiles, [("own", h, 0, 0), ("north", last_row, 0, 1), ("west", last_column, 1, 0), ("corner", corner, 1, 1)])

    def sample(i: Column) -> Column:
        r, c = F.floor(i / side).cast("int"), (i % side).cast("int")
        of = lambda name, at: F.get(F.col("strips")[name], at)
        north, west = F.when(r == 0, of("north", c)), F.when(c == 0, of("west", r))
        return F.coalesce(of("own", r * wide + c), north, west, F.when((r == 0) & (c == 0), of("corner", F.lit(0))))

    blocks = found.select("x", "y", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), sample).alias("block"))
    return blocks.filter(F.exists("block", lambda v: v.isNotNull()))


def smoothed(blocks: DataFrame, side: int) -> DataFrame:
    """x, y, block, smooth: each known sample with the mean of the known ones of the nine around it, also across the borders of blocks.

    Values do not depend on how the raster is cut into tiles.
    """
    b = F.col("block")
    row = lambda r: F.slice(b, r * side + 1, side)
    column = lambda c: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.get(b, r * side + c))
    one = lambda r, c: F.array(F.get(b, F.lit(r * side + c)))
    end = side - 1
    sent = {"0,0": b, "-1,0": row(end), "1,0": row(0), "0,-1": column(end), "0,1": column(0), "-1,-1": one(end, end), "-1,1": one(end, 0), "1,-1": one(0, end), "1,1": one(0, 0)}
    ways = {name: tuple(map(int, name.split(","))) for name in sent}  # where the sender lies, seen from the receiver: rows south, columns east
    found = met(blocks, [(name, heights, -ways[name][1], -ways[name][0]) for name, heights in sent.items()]).withColumn("block", F.col("strips")["0,0"]).filter("block is not null")

    def height(r: Column, c: Column) -> Column:
        of = lambda name, at: F.get(F.col("strips")[name], at)
        at_west, at_east = (c < 0), (c >= side)
        inside = F.when(at_west, of("0,-1", r)).when(at_east, of("0,1", r)).otherwise(of("0,0", r * side + c))
        above = F.when(at_west, of("-1,-1", F.lit(0))).when(at_east, of("-1,1", F.lit(0))).otherwise(of("-1,0", c))
        below = F.when(at_west, of("1,-1", F.lit(0))).when(at_east, of("1,1", F.lit(0))).otherwise(of("1,0", c))
        return F.when(r < 0, above).when(r >= side, below).otherwise(inside)

    def mean(v: Column, i: Column) -> Column:
        r, c = F.floor(i / side).cast("int"), (i % side).cast("int")
        near = F.filter(F.array(*(height(r + dr, c + dc).cast("double") for dr in (-1, 0, 1) for dc in (-1, 0, 1))), lambda q: q.isNotNull())
        return F.when(v.isNotNull(), F.aggregate(near, F.lit(0.0), lambda a, q: a + q) / F.size(near))

    return found.select("x", "y", "block", F.transform("block", mean).alias("smooth"))


def samples(blocks: DataFrame, side: int, step: int = 1) -> DataFrame:
    """gx, gy and the block columns of every ``step``-th sample of the whole raster, unknown ones left out."""
    named = [c for c in blocks.columns if c not in ("x", "y")]
    each = blocks.select("x", "y", F.posexplode(F.arrays_zip(*named)).alias("i", "v")).filter(F.col("v")[named[0]].isNotNull())
    placed = each.select((F.col("x") * side + F.col("i") % side).alias("gx"), (F.col("y") * side + F.floor(F.col("i") / side)).alias("gy"), *(F.col("v")[c].alias(c) for c in named))
    return placed.filter((F.pmod("gx", F.lit(step)) == 0) & (F.pmod("gy", F.lit(step)) == 0))
