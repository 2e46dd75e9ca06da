import math
import random

import pytest
from pyspark.sql import functions as F

from trailmill.operators import corridors, matching
from trailmill.plans.registry import QUERIES

XY = "array<struct<x:double,y:double>>"
SF_DIR = "/root/testdata/sf0.001"


def wandering(seed, n, spread=120.0):
    rng, out = random.Random(seed), []
    for k in range(n):
        x, y, points = rng.uniform(0, spread), rng.uniform(0, spread), []
        for _ in range(rng.randint(0, 7)):
            points.append((x, y))
            x, y = x + rng.uniform(-30, 40) * rng.choice([0, 1, 1]), y + rng.uniform(-20, 20)
        out.append((f"{k:02}", points + points[:1] if k % 5 == 0 else points))
    return out


def plain(r):
    return r.line_id, r.other_id, r.near, pytest.approx(r.d), r.steps, r.ups, r.samples


def by_rows(lines, others, keep):
    return {r[:2]: r for r in map(plain, corridors.one_way(lines, others, 15.0, 5.0, keep).collect())}


def ways(pairs, back=True):
    out = {}
    for r in pairs.collect():
        if r.near:
            assert (r.line_id, r.other_id) not in out
            out[r.line_id, r.other_id] = (r.line_id, r.other_id, r.near, r.d, r.steps, r.ups, r.samples)
        if back and r.back_near:
            out[r.other_id, r.line_id] = (r.other_id, r.line_id, r.back_near, r.back_d, r.back_steps, r.back_ups, r.back_samples)
    return out


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 4}, {"MOST_POINTS": 4}, {"BLOCK": 3, "MOST_SAMPLES": 20}])
def test_pairs_are_those_of_single_samples(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(corridors, name, value)
    lines = spark.createDataFrame(wandering(1, 30), f"line_id string, points {XY}")
    wanted = by_rows(lines, lines, F.col("line_id") != F.col("other_id"))
    assert ways(corridors.line_pairs(lines, None, 15.0, 5.0)) == wanted and len(wanted) > 100
    others = spark.createDataFrame([(int(k), p) for k, p in wandering(2, 20)], f"line_id int, points {XY}")
    there, back = by_rows(lines, others, F.lit(True)), by_rows(others, lines, F.lit(True))
    assert ways(corridors.line_pairs(lines, others, 15.0, 5.0)) == there | back
    assert ways(corridors.line_pairs(lines, others, 15.0, 5.0, back=False), back=False) == there


@pytest.mark.parametrize("limits", [{}, {"POINTS": 5, "LEGS": 4}])
def test_nearest_line_of_each_point(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(corridors, name, value)
    twice = wandering(3, 15)
    lines = spark.createDataFrame([(int(k) + 100 * copy, p, int(k) % 2) for copy in (0, 1) for k, p in twice], f"line_id int, points {XY}, kind int")
    rng = random.Random(4)
    rows = [(k % 7, k, rng.uniform(-40, 200), rng.uniform(-40, 200), rng.choice([0, 1, None])) for k in range(150)]
    points = spark.createDataFrame(rows, "line_id long, pos int, x double, y double, kind int")
    kinds = {k: kind for _, k, _, _, kind in rows}
    near = {}
    for r in matching.near_points(points.drop("kind"), lines, 15.0, F.lit(True)).collect():
        near.setdefault(r.pos, []).append((round(r.d, 6), r.other_id, r.f))
    found = {r.pos: (r.d, r.other_id, r.f) for r in corridors.nearest_lines(points.drop("kind"), lines, 15.0).collect()}
    assert found == {k: pytest.approx(min(near[k])) if k in near else (None, None, None) for _, k, *_ in rows} and 20 < len(near) < 150
    same = {k: [n for n in near.get(k, []) if n[1] % 100 % 2 == kinds[k]] for _, k, *_ in rows}
    found = {r.pos: (r.d, r.other_id, r.f) for r in corridors.nearest_lines(points, lines, 15.0, ("kind",)).collect()}
    assert found == {k: pytest.approx(min(n)) if n else (None, None, None) for k, n in same.items()}


@pytest.mark.parametrize("name", ["j01_near_points", "a01_coverage", "j03_pair_classes", "g13_trim_candidates", "j24_official", "j21_trail_of_edges", "j23_closed_edges", "r08_overlaid", "j27_class_mix", "j22_way_quality", "r08_junctions"])
def test_samples_near_lines_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "other_id" in x]
    assert "InArrow" in plan and "posexplode" not in "".join(dealt)
    assert not any("line_id" in x and ("pos" in x or name not in ("j27_class_mix", "j22_way_quality")) for x in dealt)


def test_a_hub_of_lines_is_dealt_to_blocks(spark):
    lines = spark.createDataFrame([(k, [(math.cos(k) * 50, math.sin(k) * 50), (0.0, 0.0)]) for k in range(1200)], f"line_id int, points {XY}")
    found = corridors.line_pairs(lines, None, 15.0, 5.0)
    assert found.count() == 1200 * 1199 // 2 and found.select("line_id", "other_id").distinct().count() == 1200 * 1199 // 2
