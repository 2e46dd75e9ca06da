"""Ordered folds over arrays, as higher-order functions: climbs, runs, medians, edit distance, Fréchet distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """keys, values: the values of each group in order. Groups are single tracks, so their length is that of a ride."""
    rows = F.sort_array(F.collect_list(F.struct(*order, value)))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r[value]).alias("values"))


def gain_loss(values: Column, threshold: float) -> Column:
    """Struct (gain, loss): the reference moves when it is left by the threshold; the rest counts at the end.

    gain - loss is the last value less the first. Empty arrays give zeros.
    """
    first = F.get(values, F.lit(0)).cast("double")
    zero = F.struct(first.alias("ref"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))

    def step(s: Column, e: Column) -> Column:
        d = e - s["ref"]
        return F.struct(
            F.when(F.abs(d) >= threshold, e.cast("double")).otherwise(s["ref"]).alias("ref"),
            (s["gain"] + F.when((d > 0) & (d >= threshold), d).otherwise(0.0)).alias("gain"),
            (s["loss"] + F.when((d < 0) & (-d >= threshold), -d).otherwise(0.0)).alias("loss"),
        )

    def end(s: Column) -> Column:
        rest = F.coalesce(F.get(values, F.size(values) - 1) - s["ref"], F.lit(0.0))
        return F.struct((s["gain"] + F.greatest(rest, F.lit(0.0))).alias("gain"), (s["loss"] + F.greatest(-rest, F.lit(0.0))).alias("loss"))

    return F.aggregate(values, zero, step, end)


def hysteresis_climb(values: Column, threshold: float) -> Column:
    """Struct (gain, loss) by zig-zag hysteresis: a leg ends when it is left by the threshold from its extreme."""
    first = F.get(values, F.lit(0)).cast("double")
    zero = F.struct(first.alias("ref"), first.alias("ext"), F.lit(0).alias("dir"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))

    def step(s: Column, e: Column) -> Column:
        e = e.cast("double")
        up, down, still = s["dir"] == 1, s["dir"] == -1, s["dir"] == 0
        turn_down = up & (e <= s["ext"]) & (s["ext"] - e >= threshold)
        turn_up = down & (e >= s["ext"]) & (e - s["ext"] >= threshold)
        rise, fall = still & (e - s["ref"] >= threshold), still & (s["ref"] - e >= threshold)
        moved = rise | fall | turn_down | turn_up | (up & (e > s["ext"])) | (down & (e < s["ext"]))
        return F.struct(
            F.when(turn_down | turn_up, s["ext"]).otherwise(s["ref"]).alias("ref"),
            F.when(moved, e).otherwise(s["ext"]).alias("ext"),
            F.when(rise | turn_up, 1).when(fall | turn_down, -1).otherwise(s["dir"]).alias("dir"),
            (s["gain"] + F.when(turn_down, s["ext"] - s["ref"]).otherwise(0.0)).alias("gain"),
            (s["loss"] + F.when(turn_up, s["ref"] - s["ext"]).otherwise(0.0)).alias("loss"),
        )

    def end(s: Column) -> Column:
        leg = s["ext"] - s["ref"]
        return F.struct((s["gain"] + F.when(s["dir"] == 1, leg).otherwise(0.0)).alias("gain"), (s["loss"] + F.when(s["dir"] == -1, -leg).otherwise(0.0)).alias("loss"))

    return F.aggregate(values, zero, step, end)


def edge_climb(values: Column, threshold: float) -> Column:
    """``hysteresis_climb`` and what it leaves unpaid between the first and the last value."""

    def paid(c: Column) -> Column:
        rest = F.get(values, F.size(values) - 1) - F.get(values, F.lit(0)) - (c["gain"] - c["loss"])
        return F.struct((c["gain"] + F.greatest(rest, F.lit(0.0))).alias("gain"), (c["loss"] + F.greatest(-rest, F.lit(0.0))).alias("loss"))

    return F.get(F.transform(F.array(hysteresis_climb(values, threshold)), paid), F.lit(0))


def descent_runs(heights: Column, rise: float = 15.0, loss: float = 30.0) -> Column:
    """Array of (top, bottom) indices: falls of at least ``loss`` that end where the ground rises by ``rise`` again."""
    height = lambda i: F.get(heights, i)
    zero = F.struct(F.lit(0).alias("top"), F.lit(0).alias("bottom"), F.expr("cast(array() as array<struct<top:int,bottom:int>>)").alias("runs"))

    def emitted(s: Column) -> Column:
        run = F.array(F.struct(s["top"].alias("top"), s["bottom"].alias("bottom")))
        return F.when(height(s["top"]) - height(s["bottom"]) >= loss, F.concat(s["runs"], run)).otherwise(s["runs"])

    def step(s: Column, i: Column) -> Column:
        e = height(i)
        lower, ended = e < height(s["bottom"]), e - height(s["bottom"]) >= rise
        higher = (e > height(s["top"])) | ((s["bottom"] == s["top"]) & (e == height(s["top"])))
        return (
            F.when(lower, F.struct(s["top"].alias("top"), i.alias("bottom"), s["runs"].alias("runs")))
            .when(ended, F.struct(i.alias("top"), i.alias("bottom"), emitted(s).alias("runs")))
            .when(higher, F.struct(i.alias("top"), i.alias("bottom"), s["runs"].alias("runs")))
            .otherwise(s)
        )

    found = F.aggregate(F.sequence(F.lit(0), F.size(heights) - 1), zero, step, emitted)
    return F.when(F.size(heights) > 0, found).otherwise(F.expr("cast(array() as array<struct<top:int,bottom:int>>)"))


def array_median(values: Column) -> Column:
    """The true median of an array of numbers."""
    ordered = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def smoothed(values: Column, reach: int = 3) -> Column:
    """The moving median of an array, narrower at its ends."""
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: array_median(F.slice(values, F.greatest(i - reach, F.lit(0)) + 1, F.least(i + reach, F.size(values) - 1) - F.greatest(i - reach, F.lit(0)) + 1)))


def substring_distance(needle: Column, hay: Column) -> Column:
    """Edits that turn the needle into some part of the hay: start and end in the hay are free."""
    zero = F.transform(F.sequence(F.lit(0), F.length(hay)), lambda i: F.lit(0))

    def row(before: Column, at: Column) -> Column:
        letter = F.substring(needle, at, F.lit(1))
        start = F.array(at.cast("int"))

        def cell(now: Column, j: Column) -> Column:
            cost = F.when(F.substring(hay, j, F.lit(1)) == letter, 0).otherwise(1)
            best = F.least(F.get(before, j) + 1, F.get(now, j - 1) + 1, F.get(before, j - 1) + cost)
            return F.concat(now, F.array(best))

        return F.when(F.length(hay) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(hay), F.lit(1))), start, cell)).otherwise(start)

    rows = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(needle), F.lit(1))), zero, row)
    return F.when(F.length(needle) == 0, 0).otherwise(F.array_min(rows))


def frechet(a: Column, b: Column) -> Column:
    """Discrete Fréchet distance of two arrays of (x, y); infinite if either has fewer than two points.

    The dynamic program keeps one row: for each point of a, the least reach up to each point of b.
    """
    none = F.expr("cast(array() as array<double>)")

    def reach(p: Column, before: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            q = F.get(b, j)
            d = F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
            ways = F.least(F.get(before, j), F.get(before, j - 1), F.get(row, j - 1))  # nulls do not count
            return F.concat(row, F.array(F.greatest(d, ways)))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), none, cell)

    rows = F.aggregate(a, none, lambda before, p: reach(p, before))
    return F.when((F.size(a) >= 2) & (F.size(b) >= 2), F.get(rows, F.size(b) - 1)).otherwise(F.lit(float("inf")))
