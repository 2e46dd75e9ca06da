import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_lines import XY, noisy, straight
from trailmill.functions import shapes
from trailmill.operators import tiles, trails


def at(day):
    return datetime(2024, 1, 1) + timedelta(days=day)


def test_shapes(spark):
    zigzag = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    legs = [(0.0, 0.0)]
    for k in range(6):
        x = legs[-1][0]
        legs += [(x + (0.0 if j else 0.0), y) for j, y in enumerate([legs[-1][1] + d * (10 if k % 2 == 0 else -10) for d in range(1, 9)])] + [(x + 15.0, legs[-1][1] + (80 if k % 2 == 0 else -80))]
    df = spark.createDataFrame([(zigzag, legs)], f"p {XY}, z {XY}")
    r = df.select(shapes.corners_cut(F.col("p")).alias("cut"), shapes.corners_cut(F.col("p"), 1, True).alias("ring"), shapes.turns(F.col("p")).alias("turns"), shapes.hairpins(F.col("z"), 2, 120.0).alias("pins")).first()
    assert [tuple(p) for p in r.cut] == [(0.0, 0.0), (7.5, 0.0), (10.0, 2.5), (10.0, 10.0)] and len(r.ring) == 6
    assert r.turns == [-90.0] and r.pins >= 4
    line = [(float(k), 0.2 * (k % 2), 100.0 + (20.0 if k == 5 else 0.0)) for k in range(11)]
    lines = spark.createDataFrame([("a", line), ("b", line[:1]), ("c", [(x, y, None) for x, y, _ in line])], "line_id string, points array<struct<x:double,y:double,z:double>>")
    kept = {r.line_id: r.kept for r in shapes.simplified(lines).collect()}
    assert kept == {"a": [0, 4, 5, 6, 10], "b": [0], "c": [0, 10]}
    steps = spark.createDataFrame([([(0.0, 0.0, 10.0), (3.0, 4.0, 20.0), (3.0, 14.0, 15.0)],)], "p array<struct<x:double,y:double,z:double>>").select(shapes.profile(F.col("p")).alias("s"))
    r = steps.select("s", shapes.height_on_profile(F.col("s"), F.lit(2.5)).alias("h"), shapes.height_on_profile(F.col("s"), F.lit(99.0)).alias("end"), shapes.climb_between(F.col("s"), F.lit(1.0), F.lit(9.0)).alias("up")).first()
    assert [tuple(x) for x in r.s] == [(0.0, 10.0), (5.0, 20.0), (15.0, 15.0)] and (r.h, r.end, r.up) == (15.0, 15.0, 8.0)


def test_packets(spark):
    pairs = [(0, 0), (-1, 5), (32767, -32768), (-32768, 32767)]
    df = spark.createDataFrame(pairs, "h int, l int")
    for r in df.select("h", "l", shapes.unpacked_pair(shapes.packed_pair(F.col("h"), F.col("l"))).alias("u")).collect():
        assert tuple(r.u) == (r.h, r.l)
    e = spark.range(1).select(shapes.unpacked_event(shapes.packed_event(F.lit(31), F.lit(5), F.lit(16_000_000))).alias("e")).first().e
    assert tuple(e) == (31, 5, 16_000_000)
    route = spark.range(1).select(shapes.route_points(F.lit(4_700_000), F.lit(1_100_000), F.array(shapes.packed_pair(F.lit(10), F.lit(-20)))).alias("p")).first().p
    assert [tuple(x) for x in route] == [(47.0, 11.0), (47.0001, 10.9998)]


def test_contributions(spark):
    schema = f"recording_id string, user_id string, client_id string, created_at timestamp, points {XY}"
    known = spark.createDataFrame([("k1", "t1", "u", 0.6, at(0), False, "c0", straight(101)), ("k2", "t2", "u", 0.6, at(0), True, None, straight(101, y0=300))], f"recording_id string, trail_id string, user_id string, quality double, created_at timestamp, reversed boolean, client_id string, points {XY}")
    new = [("n1", "v", "c1", at(1), noisy(straight(101)[::-1], 3, 1)), ("n2", "v", "c1", at(2), straight(101)), ("n3", "u", "c0", at(1), straight(101)), ("n4", "v", None, at(1), straight(3)), ("n5", "v", "c2", at(1), straight(41) + straight(41, x0=400.0, y0=10.0, dx=0.0, dy=10.0)), ("n6", "v", None, at(1), noisy(straight(101, y0=300), 3, 2))]
    ok = trails.accepted_recordings(known, spark.createDataFrame(new, schema))
    assert sorted(r.recording_id for r in ok.collect()) == ["n1", "n5", "n6"]
    placed, overlaps = trails.placed_recordings(known, ok)
    assert {r.recording_id: (r.trail_id, r.reversed, r.is_new) for r in placed.collect()} == {"n1": ("t1", True, False), "n5": ("t-n5", False, True), "n6": ("t2", True, False)}
    (edge,) = overlaps.filter("b = 't1'").collect()
    assert edge.a == "t-n5" and edge.coverage_ab == pytest.approx(0.5, abs=0.05)


def test_mart_and_merges(spark):
    rec = spark.createDataFrame([("t", "r1", "a", 0.4, at(0)), ("t", "r2", "b", 0.6, at(2)), ("t", "r3", "b", 0.6, at(1))], "trail_id string, recording_id string, user_id string, quality double, created_at timestamp")
    det = spark.createDataFrame([("t", "a", "Old", 1, ["x", "y"], 3, True, at(0)), ("t", "b", "New", 2, ["y"], None, True, at(0)), ("t", "c", None, 2, [], 5, False, at(0))], "trail_id string, user_id string, name string, grade int, traits array<string>, rating int, two_way boolean, created_at timestamp")
    rep = spark.createDataFrame([("t", "1", "status", "closed", None, True, at(0)), ("t", "2", "status", "open", None, False, at(1)), ("t", "3", "condition", None, 4, True, at(0))], "trail_id string, id string, kind string, status string, condition int, confirmed boolean, reported_at timestamp")
    r = trails.trail_mart(rec, det, rep, "c").first()
    assert (r.best_recording, r.grade, r.grade_min, r.rating, r.two_way, r.traits, r["name"], r.other_names, r.status, r.condition) == ("r3", 2, 1, 5, False, ["y", "x"], "Old", ["New"], "closed", 4)
    edges = spark.createDataFrame([(2, 1, True, False, 5, at(0)), (2, 3, False, True, 1, at(0)), (3, 4, True, False, 1, at(0)), (4, 2, False, False, 1, at(0))], "node long, target long, flip boolean, own boolean, by_users int, created_at timestamp")
    merges = trails.chosen_merges(edges)
    assert {(m.node, m.target) for m in merges.collect()} == {(3, 4), (4, 2)}
    moved = trails.relabelled(spark.createDataFrame([(3, False), (4, True), (9, False)], "trail_id long, reversed boolean"), merges).collect()
    assert {(m.trail_id, m.reversed) for m in moved} == {(2, True), (9, False)} or {(m.trail_id, m.reversed) for m in moved} == {(2, True), (2, True), (9, False)}
    d = trails.merged_details(spark.createDataFrame([("u", None, 1)], "user_id string, name string, grade int"), spark.createDataFrame([("u", "n", 2), ("w", "m", 3)], "user_id string, name string, grade int"), "user_id", ["name", "grade"])
    assert {tuple(x) for x in d.collect()} == {("u", "n", 1), ("w", "m", 3)}
    c = trails.merge_candidates(spark.createDataFrame([("p", "q", 0.9), ("p", "s", 0.1)], "a string, b string, share double"), spark.createDataFrame([("p", 1, at(0)), ("q", 1, at(-1)), ("s", 9, at(0))], "trail_id string, contributors int, first_at timestamp")).collect()
    assert [tuple(x) for x in c] == [("p", "q", 0.9, "q")]


def test_questions_notes_sweeps(spark):
    rep = spark.createDataFrame([("t", "1", "me", "status", True, True, at(0)), ("u", "2", "me", "status", True, True, at(0)), ("u", "3", "x", "status", False, True, at(5)), ("w", "4", "me", "status", True, True, at(20))], "trail_id string, id string, user_id string, kind string, warns boolean, confirmed boolean, reported_at timestamp")
    none = spark.createDataFrame([], "trail_id string, kind string, at timestamp")
    now = F.lit(at(40))
    assert [tuple(x) for x in trails.questions_due(rep, "me", now, none).collect()] == [("t", "status")]
    assert trails.questions_due(rep, "me", now, spark.createDataFrame([("t", "status", at(39))], none.schema)).count() == 0
    notes = spark.createDataFrame([("1", "x", at(39)), ("2", "x", at(1)), ("3", "me", at(39)), ("4", "x", at(38))], "id string, user_id string, created_at timestamp")
    assert [r.id for r in trails.fresh_notes(notes, "me", spark.createDataFrame([("4",)], "id string"), now).collect()] == ["1"]
    kept = trails.swept(notes, ["user_id"], "created_at", "id", F.lit(at(200)))
    assert sorted(r.id for r in kept.collect()) == ["1", "3"]
    gone = spark.createDataFrame([("t", "me")], "trail_id string, user_id string")
    left, counts = trails.without_contribution({"reports": rep}, gone)
    assert left["reports"].count() == 3 and tuple(counts.first()) == ("reports", 1)
    pts = spark.createDataFrame([("r", [(0.0, 0.0), (1.0, 1.0)])], f"recording_id string, points {XY}")
    good = spark.createDataFrame([("r", [(0.0, 0.01), (1.0, 1.0)], [5.0, 6.0])], f"recording_id string, points {XY}, ele array<double>")
    assert trails.attached_heights(pts, good).first().ele == [5.0, 6.0]
    assert trails.attached_heights(pts, good.withColumn("points", F.slice("points", 1, 1))).count() == 0
    p = trails.prefilled(spark.createDataFrame([("t", None, 3)], "trail_id string, name string, grade int"), spark.createDataFrame([("t", "n", 1), ("u", "m", 2)], "trail_id string, name string, grade int"), ["name", "grade"])
    assert {tuple(x) for x in p.collect()} == {("t", "n", 3), ("u", "m", 2)}
    lines = spark.createDataFrame([("a", straight(101)), ("b", straight(41, x0=200.0))], f"line_id string, points {XY}")
    assert [tuple(x) for x in trails.trim_candidates(lines).collect()] == [("a", "b")]


def test_tiles(spark):
    ring = [(0.5, 0.5), (4.5, 0.5), (4.5, 4.5), (0.5, 4.5)]
    found = {(r.x, r.y) for r in tiles.ring_tiles(spark.createDataFrame([("a", ring)], f"area_id string, ring {XY}")).collect()}
    assert found == {(x, y) for x in range(5) for y in range(5)}
    wide = [(0.5, 0.5), (300.5, 0.5), (300.5, 90.5), (0.5, 90.5)]
    assert tiles.ring_tiles(spark.createDataFrame([("a", wide), ("b", ring)], f"area_id string, ring {XY}")).count() == 301 * 91 + 25
    rng = random.Random(2)
    ids = sorted(rng.sample(range(200), 120))
    content = {i: rng.choice("abc") for i in ids}
    runs = tiles.directory_runs(spark.createDataFrame(list(content.items()), "tile_id long, content string"))
    back = {r.tile_id + k: r.content for r in runs.collect() for k in range(r.run_length)}
    assert back == content
    a = tiles.addressed(runs).first()
    assert a.addressed == 120 and a.contents == 3 and a.entries < 120
    arc = "tile_id long, z int, length long, etag string"
    diff = tiles.archive_diff(spark.createDataFrame([(1, 5, 10, "a"), (2, 5, 10, "b"), (3, 5, 10, "c"), (4, 5, 1, "d")], arc), spark.createDataFrame([(1, 5, 10, "a"), (2, 5, 10, "x"), (3, 5, 11, "y"), (5, 6, 7, "z")], arc)).collect()
    assert {(r.z, r.state, r.n) for r in diff} == {(5, "same", 1), (5, "same-length", 1), (5, "other-length", 1), (5, "removed", 1), (6, "added", 1)}
    sized = tiles.size_thirds(spark.createDataFrame([(k, 5, k, "e") for k in range(9)], arc))
    assert [r["count"] for r in sized.groupBy("third").count().orderBy("third").collect()] == [3, 3, 3]
    est = tiles.changed_share(spark.createDataFrame([(5, 1, True), (5, 1, False)], "z int, third int, changed boolean"), spark.createDataFrame([(5, 1, 100), (5, 2, 9)], "z int, third int, n long")).collect()
    assert {(r.third, r.estimated) for r in est} == {(1, 50.0), (2, 0.0)}
    grid = spark.createDataFrame([(3, x, y) for x in range(8) for y in range(8)], "z int, x int, y int")
    picked = {(r.x, r.y) for r in tiles.sampled_tiles(grid, 10).collect()}
    assert len(picked) == 10 and {(0, 0), (0, 7), (7, 0), (7, 7)} <= picked
    refs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 1), ("c", 9)], "area_id string, tile_id long")
    assert [r.tile_id for r in tiles.orphans_after(refs, spark.createDataFrame([("c",)], "area_id string")).collect()] == [9]
    left, lost = tiles.trimmed_areas(refs, spark.createDataFrame([(1,), (9,)], "tile_id long"), spark.createDataFrame([("a",)], "area_id string"))
    assert left.count() == 3 and [r.tile_id for r in lost.collect()] == [9]
    seen = spark.createDataFrame([(1, 50, at(1)), (2, 50, at(2)), (3, 10, at(3))], "tile_id long, bytes long, touched_at timestamp")
    assert [r.tile_id for r in tiles.evictions(seen, 100).collect()] == [1] and tiles.evictions(seen, 200).count() == 0
    ways = spark.createDataFrame([("path", "c", {"surface": "mud", "sac": "1"}, 500.0), ("path", "c", {"surface": "mud"}, 700.0)], "highway string, cell string, tags map<string,string>, m double")
    assert {(r.tag, r.km) for r in tiles.way_statistics(ways, F.col("m")).collect()} == {("surface", 1.2), ("sac", 0.5)}


def test_a_goal_that_nothing_leads_to_ends_the_search(spark):
    from trailmill.operators import routes

    nodes = spark.createDataFrame([(k, k * 10.0, 0.0) for k in range(80)], "node long, x double, y double")
    edges = spark.createDataFrame([(k, k + 1, 11.0 + k % 3) for k in range(79)], "a long, b long, cost double")
    pairs = spark.createDataFrame([(1, 0), (1, 5), (70, 79), (9, 9), (3, 200)], "source long, goal long")
    found = routes.cheapest_between(edges, pairs, nodes, 1.0, most_rounds=5)
    cost = lambda a, b: sum(11.0 + k % 3 for k in range(a, b))
    assert {(r.source, r.goal): r.cost for r in found.collect()} == {(1, 5): cost(1, 5), (70, 79): cost(70, 79), (9, 9): 0.0}
