"""Shapes of polylines: smoothing, simplifying, hairpins, profiles; packed numbers of watch packets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import bound, legs, segments

POINTS = "array<struct<x:double,y:double>>"


def between(a: Column, b: Column, share: float | Column) -> Column:
    """The point at a share of the way from a to b."""
    return F.struct((a["x"] + (b["x"] - a["x"]) * share).alias("x"), (a["y"] + (b["y"] - a["y"]) * share).alias("y"))


def corners_cut(points: Column, passes: int = 1, closed: bool = False) -> Column:
    """Each corner replaced by points a quarter and three quarters along its segments; open lines keep their ends."""
    for _ in range(passes):

        def once(p: Column) -> Column:
            ring = F.concat(p, F.slice(p, 1, 1)) if closed else p
            cut = F.flatten(F.transform(segments(ring), lambda s: F.array(between(s["a"], s["b"], 0.25), between(s["a"], s["b"], 0.75))))
            if closed:
                return cut
            return F.when(F.size(p) > 2, F.concat(F.slice(p, 1, 1), F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0))), F.slice(p, -1, 1))).otherwise(p)

        points = bound(points, once)
    return points


def turns(points: Column) -> Column:
    """Degrees by which each inner point turns, -180 to 180."""
    heads = F.transform(segments(points), lambda s: F.degrees(F.atan2(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])))
    turn = lambda h: F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - 1, F.lit(1))), lambda k: F.pmod(F.get(h, k) - F.get(h, k - 1) + 540, F.lit(360.0)) - 180)).otherwise(F.expr("cast(array() as array<double>)"))
    return bound(heads, turn)


def hairpins(points: Column, span: int = 6, sharp: float = 120.0) -> Column:
    """Turns of at least ``sharp`` degrees over ``span`` segments of a resampled line; after one, as many segments are passed over."""

    def count(h: Column) -> Column:
        change = lambda k: F.abs(F.pmod(F.get(h, k + span) - F.get(h, k) + 540, F.lit(360.0)) - 180)
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("free"))

        def step(s: Column, k: Column) -> Column:
            hit = (k >= s["free"]) & (change(k) >= sharp)
            return F.struct((s["n"] + hit.cast("int")).alias("n"), F.when(hit, k + span).otherwise(s["free"]).alias("free"))

        return F.when(F.size(h) > span, F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(h) - span - 1, F.lit(0))), zero, step, lambda s: s["n"])).otherwise(0)

    return bound(F.transform(segments(points), lambda s: F.degrees(F.atan2(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))), count)


def kept_by_tolerance(xyz: np.ndarray, flat: float, high: float) -> np.ndarray:
    """Which points a line keeps if others lie within ``flat`` metres aside and ``high`` metres up or down of it."""
    keep = np.zeros(len(xyz), bool)
    keep[[0, -1]] = True
    todo = [(0, len(xyz) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, inner = xyz[a, :2], xyz[b, :2], xyz[a + 1 : b]
        way = q - p
        long2 = way @ way
        t = np.clip((inner[:, :2] - p) @ way / long2, 0, 1) if long2 else np.zeros(len(inner))
        aside = np.hypot(*(inner[:, :2] - p - t[:, None] * way).T) / flat
        up = np.abs(inner[:, 2] - (xyz[a, 2] + t * (xyz[b, 2] - xyz[a, 2]))) / high
        score = np.maximum(aside, np.nan_to_num(up))
        worst = int(score.argmax())
        if score[worst] > 1:
            keep[a + 1 + worst] = True
            todo += [(a, a + 1 + worst), (a + 1 + worst, b)]
    return keep


def simplified(lines: DataFrame, flat: float = 3.0, high: float = 2.0) -> DataFrame:
    """Lines (line_id, points of x, y, z; z may be null) with ``kept``: positions that simplifying leaves.

    The recursion depends on what it has split before, so each line is worked on as one array, in Arrow batches.
    """
    kind = dict(lines.dtypes)["line_id"]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            kept = []
            for points in pdf["points"]:
                xyz = np.array([[p["x"], p["y"], np.nan if p["z"] is None else p["z"]] for p in points], float).reshape(-1, 3)
                kept.append(np.flatnonzero(kept_by_tolerance(xyz, flat, high)).astype(np.int32) if len(xyz) > 2 else np.arange(len(xyz), dtype=np.int32))
            yield pd.DataFrame({"line_id": pdf["line_id"], "kept": kept})

    return lines.select("line_id", "points").mapInPandas(batches, f"line_id {kind}, kept array<int>")


def profile(points: Column) -> Column:
    """Array of (d, e): distance from the start and height, for points of x, y and z."""
    flat = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return F.concat(
        F.transform(F.slice(points, 1, 1), lambda p: F.struct(F.lit(0.0).alias("d"), p["z"].alias("e"))),
        F.zip_with(legs(flat), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda leg, p: F.struct((leg["start"] + leg["d"]).alias("d"), p["z"].alias("e"))),
    )


def height_on_profile(steps: Column, d: Column) -> Column:
    """Height at a distance, between the two nearest steps; held at both ends."""
    before = F.element_at(F.filter(steps, lambda s: s["d"] <= d), -1)
    after = F.get(F.filter(steps, lambda s: s["d"] >= d), F.lit(0))
    return F.when(before.isNull(), after["e"]).when(after.isNull() | (after["d"] == before["d"]), before["e"]).otherwise(before["e"] + (after["e"] - before["e"]) * (d - before["d"]) / (after["d"] - before["d"]))


def climb_between(steps: Column, start: Column, stop: Column) -> Column:
    """Metres of climb of a profile between two distances."""
    inner = F.transform(F.filter(steps, lambda s: (s["d"] > start) & (s["d"] < stop)), lambda s: s["e"].cast("double"))
    heights = F.concat(F.array(height_on_profile(steps, start).cast("double")), inner, F.array(height_on_profile(steps, stop).cast("double")))
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("up"))
    return F.aggregate(heights, zero, lambda s, e: F.struct(e.alias("last"), (s["up"] + F.coalesce(F.greatest(e - s["last"], F.lit(0.0)), F.lit(0.0))).alias("up")), lambda s: s["up"])


def packed_pair(high: Column, low: Column) -> Column:
    """Two signed 16-bit numbers in one signed 32-bit number."""
    both = F.shiftleft(high.cast("int"), 16).bitwiseOR(low.cast("int").bitwiseAND(0xFFFF))
    return both.cast("int")


def unpacked_pair(packed: Column) -> Column:
    """Struct (high, low) of a packed pair."""
    return F.struct(F.shiftright(packed, 16).alias("high"), F.shiftright(F.shiftleft(packed.bitwiseAND(0xFFFF), 16), 16).alias("low"))


def packed_event(kind: Column, detail: Column, seconds: Column) -> Column:
    """An event in 32 bits: 5 for its kind, 3 for a detail, 24 for seconds."""
    return F.shiftleft(kind.cast("long"), 27).bitwiseOR(F.shiftleft(detail.cast("long"), 24)).bitwiseOR(seconds.cast("long"))


def unpacked_event(packed: Column) -> Column:
    """Struct (kind, detail, seconds) of a packed event."""
    return F.struct(F.shiftright(packed, 27).alias("kind"), F.shiftright(packed, 24).bitwiseAND(7).alias("detail"), packed.bitwiseAND(0xFFFFFF).alias("seconds"))


def route_points(origin_lat5: Column, origin_lon5: Column, packed: Column) -> Column:
    """Points (lat, lon in degrees) of an origin in 1e-5 degrees and packed pairs of steps."""
    zero = F.struct(origin_lat5.cast("long").alias("lat"), origin_lon5.cast("long").alias("lon"), F.array(F.struct((origin_lat5 / 1e5).alias("lat"), (origin_lon5 / 1e5).alias("lon"))).alias("out"))

    def step(s: Column, p: Column) -> Column:
        lat, lon = s["lat"] + unpacked_pair(p)["high"], s["lon"] + unpacked_pair(p)["low"]
        return F.struct(lat.alias("lat"), lon.alias("lon"), F.concat(s["out"], F.array(F.struct((lat / 1e5).alias("lat"), (lon / 1e5).alias("lon")))).alias("out"))

    return F.aggregate(packed, zero, step, lambda s: s["out"])
