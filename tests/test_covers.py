import math
import random

from pyspark.sql import functions as F

from tests.test_lines import XY
from trailmill.functions.geo import hilbert_id
from trailmill.operators import covers, tiles


def numbers(ranges):
    found = {}
    for r in ranges.collect():
        own = found.setdefault(r.area_id, [])
        assert not own or r.start not in own
        own.extend(range(r.start, r.end))
    return {k: sorted(v) for k, v in found.items()}


def test_ranges_are_the_tiles_of_a_ring(spark):
    rng = random.Random(4)
    star = lambda cx, cy, n, low, high: [(cx + math.cos(2 * math.pi * k / n) * (r := rng.uniform(low, high)), cy + math.sin(2 * math.pi * k / n) * r) for k in range(n)]
    rings = [("star", star(25.3, 30.2, 23, 4, 18)), ("small", [(5.2, 5.2), (5.4, 5.2), (5.3, 5.5)]), ("grid", [(8.0, 8.0), (16.0, 8.0), (16.0, 24.0), (8.0, 24.0)]), ("thin", [(40.1, 2.5), (60.9, 50.3), (40.2, 2.5)]), ("all", [(0.1, 0.1), (63.9, 0.1), (63.9, 63.9), (0.1, 63.9)])]
    df = spark.createDataFrame(rings, f"area_id string, ring {XY}")
    base = ((1 << 12) - 1) // 3
    wanted = {}
    for r in tiles.ring_tiles(df).select("area_id", (hilbert_id(6, F.col("x"), F.col("y")) - base).alias("h")).collect():
        wanted.setdefault(r.area_id, []).append(r.h)
    ranges = covers.area_ranges(df, 6).cache()
    found = numbers(ranges)
    assert found == {k: sorted(v) for k, v in wanted.items()}
    assert ranges.filter("area_id = 'all'").count() == 1
    up, down = numbers(covers.ranges_at(ranges, 6, 4)), numbers(covers.ranges_at(ranges, 6, 7))
    assert up == {k: sorted({h // 16 for h in v}) for k, v in found.items()} and down == {k: [h * 4 + i for h in v for i in range(4)] for k, v in found.items()}
    assert covers.area_ranges(df.limit(0), 6).count() == 0


def test_a_hole_and_a_large_area(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    df = spark.createDataFrame([("a", square(2.5, 29.5)), ("a", square(8.5, 19.5))], f"area_id string, ring {XY}")
    assert sum(r.end - r.start for r in covers.area_ranges(df, 5).collect()) == 28 * 28 - 10 * 10
    big = covers.area_ranges(spark.createDataFrame([("a", square(100.5, 15000.5))], f"area_id string, ring {XY}"), 14)
    assert big.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == 14901**2
