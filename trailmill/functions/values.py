"""Small rules on values: dates, ranges, arrays, maps, geometry texts, paths of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of the limits that are offered to be raised, and their ends; days that a counter stays fresh.
CLIMB_STEP_M, MOST_CLIMB_M, DISTANCE_STEP_KM, MOST_KM, FRESH_DAYS = 100.0, 3000.0, 5.0, 100.0, 30


def month_of(day: Column) -> Column:
    """The first day of a date's month."""
    return F.trunc(day, "MM")


def provider_time(text: Column) -> Column:
    """A time written as month/day/year with a twelve-hour clock, null if it has another form."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm:ss a"))


def week_label(day: Column) -> Column:
    """ISO year and week, as ``2024-W07``."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def fresh_by_day(at: Column, now: Column, days: int = FRESH_DAYS) -> Column:
    """Is a time at most so many calendar days back? Hours do not count."""
    return F.to_date(at) >= F.date_sub(F.to_date(now), days)


def deciseconds(seconds: Column, most: int) -> Column:
    """Tenths of seconds, rounded half up, from 0 to ``most``."""
    return F.greatest(F.lit(0), F.least(F.lit(most), F.round(seconds * 10))).cast("int")


def appended(values: Column, value: Column) -> Column:
    """An array with a value at its end unless it has it."""
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def subset_of(some: Column, all_: Column) -> Column:
    """Are all values of one array in another?"""
    return F.size(F.array_except(some, all_)) == 0


def turned(points: Column, reversed_: Column) -> Column:
    """A line the other way round where it is recorded so."""
    return F.when(F.coalesce(reversed_, F.lit(False)), F.reverse(points)).otherwise(points)


def interleaved(lons: Column, lats: Column) -> Column:
    """One flat array of lon, lat, lon, lat, ... of two arrays."""
    return F.flatten(F.zip_with(lons, lats, lambda x, y: F.array(x, y)))


def counts_text(counts: Column) -> Column:
    """A map of counts as text, keys in order: ``a=1;b=2``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def counts_of(text: Column) -> Column:
    """The map that ``counts_text`` wrote; parts without a whole number do not count."""
    pairs = F.filter(F.transform(F.split(text, ";"), lambda p: F.split(p, "=")), lambda p: (F.size(p) == 2) & F.get(p, F.lit(1)).try_cast("int").isNotNull())
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)).try_cast("int"))))


def line_geojson(points: Column) -> Column:
    """A line of lon and lat as GeoJSON text."""
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")))


def line_of_geojson(text: Column) -> Column:
    """Points (lon, lat) of a GeoJSON line, null if it is none."""
    read = F.from_json(text, "type string, coordinates array<array<double>>")
    return F.when(read["type"] == "LineString", F.transform(read["coordinates"], lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat"))))


def exactly_one(a: Column, b: Column) -> Column:
    """Is one of two values there, and not the other?"""
    return a.isNull() != b.isNull()


def request_kind(path: Column) -> Column:
    """What a request to the map host asks for, by its path. The prefixes and endings of its files."""
    file = F.substring_index(path, "/", -1)
    archive = F.when(file.startswith("ways-"), "ways").when(file.startswith("heights-"), "heights").when(file.rlike("^(dach|map|overview)-"), "map").otherwise("other")
    return F.when(file.endswith(".pmtiles"), archive).when(~file.endswith(".json"), "other").when(F.contains(path, F.lit("/names/")), "names").when(file.rlike(r"^-?\d+_-?\d+\.[A-Za-z]+\.json$"), "pois").otherwise("manifest")


def offered_limit(value: Column, limit: Column, declined: Column, step: float = CLIMB_STEP_M, most: float = MOST_CLIMB_M) -> Column:
    """The limit that is offered after a ride of this value, null if none: a whole step above both the limit and what was declined."""
    whole = F.floor(value / step) * step
    asks = (limit < most) & (whole >= limit + step) & (declined.isNull() | (whole >= declined + step))
    return F.when(asks, F.least(whole, F.lit(most)))


def clipped_north(ring: Column, north: Column) -> Column:
    """The part of a ring (x, y; first point not repeated) at or below ``north``; fewer than three points are none."""
    n = F.size(ring)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none = F.expr("cast(array() as array<struct<x:double,y:double>>)")

    def corner(p: Column, k: Column) -> Column:
        before = F.get(ring, F.pmod(k - 1 + n, n).cast("int"))
        cut = F.when((p["y"] <= north) != (before["y"] <= north), F.array(point(before["x"] + (north - before["y"]) / (p["y"] - before["y"]) * (p["x"] - before["x"]), north))).otherwise(none)
        return F.concat(cut, F.when(p["y"] <= north, F.array(point(p["x"], p["y"]))).otherwise(none))

    clipped = F.flatten(F.transform(ring, corner))
    return F.when(F.size(clipped) >= 3, clipped).otherwise(none)


def stored_in_track(stored: Column, raw: Column, reach: float = 1e-7) -> Column:
    """Positions in a raw track of the points of a stored line, in order; null if the ends differ or a point is not found."""
    same = lambda a, b: (F.abs(a["x"] - b["x"]) <= reach) & (F.abs(a["y"] - b["y"]) <= reach)
    zero = F.struct(F.lit(0).alias("k"), F.expr("cast(array() as array<int>)").alias("at"))

    def step(s: Column, i: Column) -> Column:
        hit = (s["k"] < F.size(stored)) & F.coalesce(same(F.get(raw, i), F.get(stored, s["k"])), F.lit(False))
        return F.struct((s["k"] + hit.cast("int")).alias("k"), F.when(hit, F.array_append(s["at"], i)).otherwise(s["at"]).alias("at"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(raw) - 1), zero, step, lambda s: s["at"])
    ends = same(F.get(raw, F.lit(0)), F.get(stored, F.lit(0))) & same(F.element_at(raw, -1), F.element_at(stored, -1))
    return F.when((F.size(stored) >= 2) & (F.size(raw) >= 2) & ends & (F.size(found) == F.size(stored)), found)
