"""Geometry on columns: distances, projections, tiles, cells, polylines as arrays of points.

Points are structs of lat and lon (degrees) or of x and y (metres on a plane); polylines are arrays of
them. Everything is a column expression, so it runs inside generated code or higher-order functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius in metres, and metres of a degree in flat distances.
EARTH_M = 6_371_000.0
DEGREE_M = 111_200.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane around both points: fine for a few kilometres."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + (lat2 - lat1) * (lat2 - lat1)) * DEGREE_M


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360, north is 0."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass_point(degrees: Column) -> Column:
    """The nearest of eight compass points."""
    return F.get(F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), F.pmod(F.floor((degrees + 22.5) / 45), F.lit(8)).cast("int"))


def projected(points: Column, lat0: Column) -> Column:
    """Points in metres on a plane that touches the parallel ``lat0``."""
    k = math.pi / 180 * EARTH_M
    return F.transform(points, lambda p: F.struct((p["lon"] * F.cos(F.radians(lat0)) * k).alias("x"), (p["lat"] * k).alias("y")))


def unprojected(points: Column, lat0: Column) -> Column:
    """Points in degrees from metres on the plane of ``lat0``."""
    k = math.pi / 180 * EARTH_M
    return F.transform(points, lambda p: F.struct((p["y"] / k).alias("lat"), (p["x"] / k / F.cos(F.radians(lat0))).alias("lon")))


def utm_zone(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone of a point."""
    return (F.when(lat >= 0, 32600).otherwise(32700) + F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))).cast("int")


def segments(points: Column) -> Column:
    """Array of (a, b) for each two neighbours."""
    return F.when(F.size(points) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.struct(F.get(points, i - 1).alias("a"), F.get(points, i).alias("b")))).otherwise(
        F.filter(F.transform(points, lambda p: F.struct(p.alias("a"), p.alias("b"))), lambda s: F.lit(False))
    )


def distance(a: Column, b: Column) -> Column:
    """Metres between two points of a plane."""
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def line_length(points: Column) -> Column:
    """Length of a polyline in metres of its plane."""
    return F.aggregate(F.transform(segments(points), lambda s: distance(s["a"], s["b"])), F.lit(0.0), lambda total, d: total + d)


def track_length(points: Column) -> Column:
    """Length of a polyline of degrees along the sphere."""
    return F.aggregate(F.transform(segments(points), lambda s: haversine(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"])), F.lit(0.0), lambda total, d: total + d)


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct (d, t): distance of a point from a segment, and the share of the segment where its foot is."""
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / long2))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.struct(F.sqrt(ex * ex + ey * ey).alias("d"), t.alias("t"))


def distance_to_line(p: Column, points: Column) -> Column:
    """Distance of a point from a polyline; null if it has no segment."""
    return F.array_min(F.transform(segments(points), lambda s: point_segment(p["x"], p["y"], s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])["d"]))


def coverage(a: Column, b: Column, corridor: float) -> Column:
    """Share of the points of a that lie within the corridor of line b."""
    near = F.filter(a, lambda p: distance_to_line(p, b) <= corridor)
    return F.size(near) / F.nullif(F.size(a), F.lit(0))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, although it is named several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def legs(points: Column) -> Column:
    """Array of (a, b, start, d) for each segment: its ends, the length before it and its own."""
    zero = F.struct(F.lit(0.0).alias("total"), F.expr("cast(array() as array<struct<ax:double,ay:double,bx:double,by:double,start:double,d:double>>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        d = distance(s["a"], s["b"])
        leg = F.struct(s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), s["b"]["x"].alias("bx"), s["b"]["y"].alias("by"), acc["total"].alias("start"), d.alias("d"))
        return F.struct((acc["total"] + d).alias("total"), F.concat(acc["out"], F.array(leg)).alias("out"))

    return F.aggregate(segments(points), zero, step, lambda acc: acc["out"])


def resampled(points: Column, step: float | Column) -> Column:
    """Points every ``step`` metres of arc length, both ends kept; fewer than two points stay as they are.

    Each segment emits its own multiples of the step from the length before it.
    """
    none = F.expr("cast(array() as array<struct<x:double,y:double>>)")

    def emit(leg: Column) -> Column:
        first, last = F.floor(leg["start"] / step) + 1, F.floor((leg["start"] + leg["d"]) / step)
        at = lambda k: (k * step - leg["start"]) / leg["d"]
        made = F.transform(F.sequence(first, F.greatest(last, first)), lambda k: F.struct((leg["ax"] + (leg["bx"] - leg["ax"]) * at(k)).alias("x"), (leg["ay"] + (leg["by"] - leg["ay"]) * at(k)).alias("y")))
        return F.when((leg["d"] > 0) & (last >= first), made).otherwise(none)

    plain = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    head = F.transform(F.slice(points, 1, 1), plain)
    end = plain(F.element_at(points, -1))

    def closed(body: Column) -> Column:
        return F.when(F.element_at(body, -1) == end, body).otherwise(F.concat(body, F.array(end)))

    return F.when(F.size(points) < 2, F.transform(points, plain)).otherwise(bound(F.concat(head, F.flatten(F.transform(legs(points), emit))), closed))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Is a point inside a ring (even-odd)? Rings of fewer than three points hold nothing."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    crossing = F.filter(segments(closed), lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"]))
    return (F.size(ring) >= 3) & (F.size(crossing) % 2 == 1)


def mostly_in_ring(points: Column, ring: Column) -> Column:
    """Do more than half of a line's points lie in a ring?"""
    return F.size(F.filter(points, lambda p: in_ring(p["x"], p["y"], ring))) * 2 > F.size(points)


def box_of(points: Column) -> Column:
    """Struct (x0, y0, x1, y1) around a polyline."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def boxes_near(a: Column, b: Column, margin: float) -> Column:
    """Are two boxes at most a margin apart?"""
    return (a["x0"] - margin <= b["x1"]) & (b["x0"] - margin <= a["x1"]) & (a["y0"] - margin <= b["y1"]) & (b["y0"] - margin <= a["y1"])


def segment_meets_box(s: Column, box: Column) -> Column:
    """Does a segment touch a box? The part of it inside all four half planes is not empty."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]

    def span(d: Column, low: Column, high: Column, start: Column) -> tuple[Column, Column]:
        t0, t1 = (low - start) / F.nullif(d, F.lit(0.0)), (high - start) / F.nullif(d, F.lit(0.0))
        inside = (start >= low) & (start <= high)
        return F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(t0, t1)), F.when(d == 0, 1.0).otherwise(F.greatest(t0, t1))

    x0, x1 = span(dx, box["x0"], box["x1"], s["a"]["x"])
    y0, y1 = span(dy, box["y0"], box["y1"], s["a"]["y"])
    return F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))


def line_meets_box(points: Column, box: Column) -> Column:
    """Does any part of a line lie in a box?"""
    inside = F.exists(points, lambda p: p["x"].between(box["x0"], box["x1"]) & p["y"].between(box["y0"], box["y1"]))
    return inside | F.exists(segments(points), lambda s: segment_meets_box(s, box))


def crossing_point(a: Column, b: Column) -> Column:
    """Where two segments cross properly, as (x, y); null if they do not."""
    ax, ay, bx, by = a["a"]["x"], a["a"]["y"], b["a"]["x"], b["a"]["y"]
    rx, ry, sx, sy = a["b"]["x"] - ax, a["b"]["y"] - ay, b["b"]["x"] - bx, b["b"]["y"] - by
    cross = rx * sy - ry * sx
    t, u = ((bx - ax) * sy - (by - ay) * sx) / F.nullif(cross, F.lit(0.0)), ((bx - ax) * ry - (by - ay) * rx) / F.nullif(cross, F.lit(0.0))
    return F.when((t > 0) & (t < 1) & (u > 0) & (u < 1), F.struct((ax + t * rx).alias("x"), (ay + t * ry).alias("y")))


def tile_x(lon: Column, zoom: int) -> Column:
    """Column of the slippy tile of a longitude."""
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180) / 360 * n))).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    """Row of the slippy tile of a latitude."""
    n = 1 << zoom
    r = F.radians(lat)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n))).cast("int")


def hilbert_id(zoom: int, x: Column, y: Column) -> Column:
    """Number of a tile along the Hilbert curve of its zoom, after all tiles of lower zooms."""
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(((1 << 2 * zoom) - 1) // 3).cast("long").alias("id"))

    def step(s: Column, level: Column) -> Column:
        size = F.expr("1L") * F.pow(F.lit(2.0), level).cast("long")
        rx, ry = F.pmod(F.floor(s["x"] / size), F.lit(2)).cast("long"), F.pmod(F.floor(s["y"] / size), F.lit(2)).cast("long")
        quadrant = F.when(rx == 1, 3).otherwise(0).bitwiseXOR(ry.cast("int")).cast("long")
        fx, fy = F.when((ry == 0) & (rx == 1), size - 1 - F.pmod(s["x"], size)).otherwise(F.pmod(s["x"], size)), F.when((ry == 0) & (rx == 1), size - 1 - F.pmod(s["y"], size)).otherwise(F.pmod(s["y"], size))
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), (s["id"] + quadrant * size * size).alias("id"))

    return F.aggregate(F.sequence(F.lit(zoom - 1), F.lit(0), F.lit(-1)), state, step, lambda s: s["id"]) if zoom else F.lit(0).cast("long")


def tiles_of_box(lat0: Column, lon0: Column, lat1: Column, lon1: Column, zoom: int) -> Column:
    """Array of (x, y) of all tiles that a box touches."""
    xs = F.sequence(tile_x(lon0, zoom), tile_x(lon1, zoom))
    ys = F.sequence(tile_y(lat1, zoom), tile_y(lat0, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def grid_cell(lat: Column, lon: Column, height: float = 0.1, width: float = 0.15) -> Column:
    """Row and column of a fixed grid of degrees, as a key."""
    return F.concat_ws("_", F.floor(lat / height).cast("string"), F.floor(lon / width).cast("string"))


def near_cell(lat: Column, lon: Column, size: float = 0.045) -> Column:
    """Cell of about equal sides: columns widen with the cosine of the row's middle."""
    row = F.floor(lat / size)
    wide = size / F.greatest(F.cos(F.radians((row + 0.5) * size)), F.lit(0.01))
    return F.struct(row.cast("int").alias("row"), F.floor(lon / wide).cast("int").alias("column"))


def bilinear(corners: Column, fx: Column, fy: Column) -> Column:
    """Height between four corners (nw, ne, sw, se); null if one of them is."""
    top = corners["nw"] + (corners["ne"] - corners["nw"]) * fx
    bottom = corners["sw"] + (corners["se"] - corners["sw"]) * fx
    return top + (bottom - top) * fy


def height_at(values: Column, side: int, fx: Column, fy: Column, nodata: int = -32768) -> Column:
    """Bilinear height in a square raster of ``side`` points a side; fx and fy run from 0 to 1 from the north-west."""
    gx, gy = fx * (side - 1), fy * (side - 1)
    x, y = F.least(F.floor(gx), F.lit(side - 2)).cast("int"), F.least(F.floor(gy), F.lit(side - 2)).cast("int")
    value = lambda dx, dy: F.nullif(F.get(values, (y + dy) * side + x + dx), F.lit(nodata)).cast("double")
    return bilinear(F.struct(value(0, 0).alias("nw"), value(1, 0).alias("ne"), value(0, 1).alias("sw"), value(1, 1).alias("se")), gx - x, gy - y)


def valid_heights(heights: Column) -> Column:
    """Heights if all are there and within -500 to 9000 m, else null as a whole."""
    return F.when(F.forall(heights, lambda h: F.coalesce(h.between(-500, 9000), F.lit(False))), heights)
