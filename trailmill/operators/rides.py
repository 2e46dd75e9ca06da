"""Ride analytics: a recorded ride becomes known trails, candidate descents and calibration figures.

Points are (ride_id, seq, t in seconds, lat, lon, x, y in metres, acc_m, alt_m). A ride is an array of its points in order where
the work is a fold, and rows where it is a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.folds import descent_runs, smoothed
from .groups import true_median
from .matching import CORRIDOR_M, SAME, coverages, near_points

# Accuracy of used points, holes bridged in a section, home radius, share off roads, lengths and falls of candidates.
ACCURACY_M, HOLE, HOME_M, OFF_ROAD, LEAST_M, LEAST_LOSS_M = 30.0, 2, 300.0, 0.7, 50.0, 30.0


def usable(points: DataFrame) -> DataFrame:
    """Points that are accurate enough, or tell no accuracy."""
    return points.filter(F.col("acc_m").isNull() | (F.col("acc_m") <= ACCURACY_M))


def descents(points: DataFrame) -> DataFrame:
    """ride_id, top, bottom (positions among the usable points), fall: descents of the smoothed heights."""
    rows = F.sort_array(F.collect_list(F.struct("seq", F.col("alt_m").cast("double").alias("alt"))))
    rides = usable(points).filter("alt_m is not null").groupBy("ride_id").agg(rows.alias("rows"))
    heights = rides.select("ride_id", smoothed(F.transform("rows", lambda r: r["alt"])).alias("h"))
    runs = heights.select("ride_id", "h", F.explode(descent_runs(F.col("h"))).alias("r"))
    return runs.select("ride_id", "r.top", "r.bottom", (F.get("h", F.col("r.top")) - F.get("h", F.col("r.bottom"))).alias("fall"))


def candidates(points: DataFrame, runs: DataFrame) -> DataFrame:
    """ride_id, top, bottom, first, last, length_m: descents without their ends on roads, if enough is left off roads.

    ``points`` carry ``on_road``; their position is counted among usable points with heights.
    """
    at = F.row_number().over(W.partitionBy("ride_id").orderBy("seq")) - 1
    step = F.sqrt((F.col("x") - F.lag("x").over(W.partitionBy("ride_id").orderBy("seq"))) ** 2 + (F.col("y") - F.lag("y").over(W.partitionBy("ride_id").orderBy("seq"))) ** 2)
    rows = usable(points).filter("alt_m is not null").withColumns({"pos": at, "step": step})
    inside = runs.join(rows, "ride_id").filter(F.col("pos").between(F.col("top"), F.col("bottom")))
    ends = inside.filter("not on_road").groupBy("ride_id", "top", "bottom").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    kept = inside.join(ends, ["ride_id", "top", "bottom"]).filter(F.col("pos").between(F.col("first"), F.col("last")))
    sums = kept.groupBy("ride_id", "top", "bottom", "first", "last").agg(
        F.sum(F.when(F.col("pos") > F.col("first"), F.col("step"))).alias("length_m"),
        F.avg((~F.col("on_road")).cast("int")).alias("off_road"),
        (F.max_by("alt_m", -F.col("pos")) - F.max_by("alt_m", "pos")).alias("loss_m"),
    )
    return sums.filter((F.col("length_m") >= LEAST_M) & (F.col("loss_m") >= LEAST_LOSS_M) & (F.col("off_road") > OFF_ROAD)).drop("off_road")


def known_sections(points: DataFrame, trails: DataFrame) -> DataFrame:
    """ride_id, trail_id, first, last: the longest run of each ride along each known trail, without overlaps.

    A run may miss up to two points; ride and trail must both cover the other; of overlapping runs the longest wins.
    """
    at = F.row_number().over(W.partitionBy("ride_id").orderBy("seq")) - 1
    rows = usable(points).withColumn("pos", at).select(F.col("ride_id").alias("line_id"), "pos", "x", "y")
    lines = trails.select(F.col("trail_id").alias("line_id"), "points")
    near = near_points(rows, lines, CORRIDOR_M, F.lit(True)).select(F.col("line_id").alias("ride_id"), F.col("other_id").alias("trail_id"), "pos")
    over = W.partitionBy("ride_id", "trail_id").orderBy("pos")
    fresh = F.when(F.col("pos") - F.lag("pos").over(over) > HOLE + 1, 1).otherwise(0)
    runs = near.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(over.rowsBetween(W.unboundedPreceding, 0))).groupBy("ride_id", "trail_id", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    longest = runs.withColumn("at", F.row_number().over(W.partitionBy("ride_id", "trail_id").orderBy(F.desc(F.col("last") - F.col("first")), "first"))).filter("at = 1").drop("at", "run")
    cut = longest.join(rows.withColumnRenamed("line_id", "ride_id"), "ride_id").filter(F.col("pos").between(F.col("first"), F.col("last")))
    key = F.concat_ws("|", F.lit("r"), F.col("ride_id").cast("string"), F.col("trail_id").cast("string"))
    parts = cut.groupBy("ride_id", "trail_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("p")).select(key.alias("line_id"), F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    both = coverages(parts.unionByName(trails.select(F.concat(F.lit("t|"), F.col("trail_id").cast("string")).alias("line_id"), "points")))
    trail = lambda c: F.element_at(F.split(c, r"\|"), -1)
    ok = both.filter((F.col("cov") >= SAME) & (trail("line_id") == trail("other_id")))
    there = ok.filter("line_id like 'r|%' and other_id like 't|%'").select(F.col("line_id").alias("k"))
    back = ok.filter("line_id like 't|%' and other_id like 'r|%'").select(F.col("other_id").alias("k"))
    sure = longest.withColumn("k", key).join(there, "k", "left_semi").join(back, "k", "left_semi").drop("k")
    return without_overlaps(sure, "ride_id", "first", "last", "trail_id")


def without_overlaps(df: DataFrame, key: str, first: str, last: str, tie: str) -> DataFrame:
    """Of overlapping spans of one key the longest stays, of equals the earliest. Spans of one key are few (those of a ride)."""
    schema = df.schema

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.assign(__n=pdf[first] - pdf[last]).sort_values(["__n", first, tie]).drop(columns="__n")
        kept: list[tuple] = []
        rows = []
        for row in ordered.itertuples(index=False):
            a, b = getattr(row, first), getattr(row, last)
            if all(b < x or a > y for x, y in kept):
                kept.append((a, b))
                rows.append(row)
        return pd.DataFrame(rows, columns=pdf.columns)

    return df.groupBy(key).applyInPandas(pick, schema)


def home_flags(points: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections (ride_id, first, last) with ``home``: does one end lie near the ride's first or last point?"""
    at = F.row_number().over(W.partitionBy("ride_id").orderBy("seq")) - 1
    rows = usable(points).withColumn("pos", at).select("ride_id", "pos", "x", "y")
    ends = rows.groupBy("ride_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("start"), F.max_by(F.struct("x", "y"), "pos").alias("stop"))
    met = sections.join(rows, "ride_id").filter((F.col("pos") == F.col("first")) | (F.col("pos") == F.col("last"))).join(ends, "ride_id")
    near = lambda end: F.sqrt((F.col("x") - F.col(f"{end}.x")) ** 2 + (F.col("y") - F.col(f"{end}.y")) ** 2) <= HOME_M
    flag = F.bool_or(near("start") | near("stop"))
    return met.groupBy(*sections.columns).agg(flag.alias("home"))


def ascent_sections(points: DataFrame, least_gain: float = 100.0, drop_end: float = 15.0) -> DataFrame:
    """ride_id, first, top, gain, seconds: climbs of the smoothed heights that end where they fall back by ``drop_end``.

    The next climb is looked for from the top of the last one. Rides are folded one by one, each as an ordered group.
    """
    rows = F.sort_array(F.collect_list(F.struct("seq", F.col("t").cast("double").alias("t"), F.col("alt_m").cast("double").alias("alt"))))
    rides = usable(points).filter("alt_m is not null").groupBy("ride_id").agg(rows.alias("rows")).filter(F.size("rows") >= 7)
    folded = rides.select("ride_id", F.transform("rows", lambda r: r["t"]).alias("t"), smoothed(F.transform("rows", lambda r: r["alt"])).alias("h"))
    kind = folded.schema["ride_id"].dataType.simpleString()

    def climbs(h: list[float]) -> Iterator[tuple[int, int]]:
        low = 0
        while low + 1 < len(h):
            if h[low + 1] <= h[low]:
                low += 1
                continue
            top, at = low, low + 1
            while at < len(h) and not (h[at] <= h[top] and h[top] - h[at] >= drop_end):
                top = at if h[at] > h[top] else top
                at += 1
            yield low, top
            low = max(top, at)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [(ride, a, b, h[b] - h[a], t[b] - t[a]) for ride, t, h in zip(pdf["ride_id"], pdf["t"], pdf["h"]) for a, b in climbs(list(h)) if h[b] - h[a] >= least_gain]
            yield pd.DataFrame(found, columns=["ride_id", "first", "top", "gain", "seconds"])

    return folded.mapInPandas(batches, f"ride_id {kind}, first int, top int, gain double, seconds double")


def climb_calibration(sections: DataFrame, least_s: float = 300.0, low: float = 150.0, high: float = 1500.0, least: int = 3) -> DataFrame:
    """ride_id, climb_rate: the median of the plausible rates in m/h, null with fewer than three."""
    rate = F.col("gain") / F.col("seconds") * 3600
    good = sections.filter(F.col("seconds") > least_s).withColumn("rate", rate).filter(F.col("rate").between(low, high))
    return good.groupBy("ride_id").agg(F.when(F.count("*") >= least, true_median(F.col("rate"))).alias("climb_rate"))


def guessed_rider(rate: Column) -> Column:
    """muscle or electric by a climb rate: the geometric mean of both riders' rates less or more 10 % divides them."""
    from ..functions.routing import RIDERS

    border = (RIDERS[0][1] * RIDERS[1][1]) ** 0.5
    return F.when(rate < border * 0.9, RIDERS[0][0]).when(rate > border * 1.1, RIDERS[1][0])


def live_totals(points: DataFrame) -> DataFrame:
    """Each point with moved_m and moving_s up to it: steps count while faster than 1 m/s and shorter than 100 m."""
    over = W.partitionBy("ride_id").orderBy("seq")
    step = F.sqrt((F.col("x") - F.lag("x").over(over)) ** 2 + (F.col("y") - F.lag("y").over(over)) ** 2)
    seconds = F.col("t") - F.lag("t").over(over)
    rows = points.withColumns({"__d": step, "__s": seconds})
    counts = (F.col("__s") > 0) & (F.col("__d") / F.col("__s") >= 1) & (F.col("__d") <= 100)
    upto = over.rowsBetween(W.unboundedPreceding, 0)
    moved = lambda c: F.coalesce(F.sum(F.when(counts, F.col(c))).over(upto), F.lit(0.0))
    return rows.withColumns({"moved_m": moved("__d"), "moving_s": moved("__s")}).drop("__d", "__s")


def folded_marks(marks: DataFrame) -> DataFrame:
    """Marks (ride_id, seq, kind, name) after amendments: a label renames the range before it, a discard removes it.

    Ranges are start and end marks in turn; returned are ride_id, range_no, first, last, name.
    """
    over = W.partitionBy("ride_id").orderBy("seq")
    ends = marks.filter("kind in ('start', 'end')").withColumn("at", F.row_number().over(over) - 1).withColumn("range_no", F.floor(F.col("at") / 2))
    ranges = ends.groupBy("ride_id", "range_no").agg(F.min("seq").alias("first"), F.when(F.count("*") == 2, F.max("seq")).alias("last"), F.first("name", ignorenulls=True).alias("own_name"))
    later = marks.filter("kind in ('label', 'discard')").select("ride_id", F.col("seq").alias("mark_seq"), "kind", F.col("name").alias("label"))
    following = F.lead("first").over(W.partitionBy("ride_id").orderBy("range_no"))
    spans = ranges.withColumn("until", F.coalesce(following, F.lit(1 << 60)))
    met = spans.join(later, "ride_id", "left")
    hit = F.col("mark_seq").between(F.col("first"), F.col("until"))
    told = met.groupBy("ride_id", "range_no", "first", "last", "own_name").agg(F.max_by("label", F.when(hit & (F.col("kind") == "label"), F.col("mark_seq"))).alias("label"), F.bool_or(hit & (F.col("kind") == "discard")).alias("gone"))
    return told.filter(~F.coalesce("gone", F.lit(False))).select("ride_id", "range_no", "first", "last", F.coalesce("label", "own_name").alias("name"))
