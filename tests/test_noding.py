import random

import pytest
from pyspark.sql import functions as F

from tests.test_lines import XY, straight
from trailmill.operators import accounts, graphs, groups, noding, routes

LINES = f"line_id string, level int, points {XY}"


def rounded(x, y):
    return tuple(int((v * 1000 + 0.5) // 1) for v in (x, y))


def brute(lines):
    """Pieces (line, nodes of both ends) by holding each two segments of one level against each other."""
    seen, cuts = {}, {}
    for _, _, points in lines:
        for p in points:
            seen[rounded(*p)] = seen.get(rounded(*p), 0) + 1
    for name, _, points in lines:
        cuts[name] = [(k, rounded(*p)) for k, p in enumerate(points) if seen[rounded(*p)] > 1 or k in (0, len(points) - 1)]
    segments = []
    for name, level, points in lines:
        part = 0
        for k in range(len(points) - 1):
            if k and seen[rounded(*points[k])] > 1:
                part += 1
            segments.append((name, part, level, k, points[k], points[k + 1]))
    for i, (n1, p1, l1, k1, a, b) in enumerate(segments):
        for n2, p2, l2, k2, c, d in segments[i + 1 :]:
            if l1 != l2 or (n1, p1) == (n2, p2):
                continue
            rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
            slope = rx * sy - ry * sx
            if abs(slope) < 1e-9:
                continue
            t, u = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / slope, ((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) / slope
            if 1e-3 < t < 1 - 1e-3 and 1e-3 < u < 1 - 1e-3:
                node = rounded(a[0] + t * rx, a[1] + t * ry)
                cuts[n1].append((k1 + t, node))
                cuts[n2].append((k2 + u, node))
    out = []
    for name, at in cuts.items():
        nodes = [n for _, n in sorted(at)]
        out += [(name, m, n) for m, n in zip(nodes, nodes[1:]) if m != n]
    return sorted(out)


def pieces(df):
    return sorted((r.line_id, *(tuple(map(int, e.split(","))) for e in (r.a, r.b))) for r in df.collect())


def test_pieces_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    lines = [(f"l{k:02}", k % 3 // 2, [(rng.uniform(0, 120), rng.uniform(0, 120)) for _ in range(rng.randint(2, 6))]) for k in range(30)]
    lines += [("s0", 0, [(0.0, 60.0), (60.0, 60.0), (120.0, 60.0)]), ("s1", 0, [(60.0, 0.0), (60.0, 60.0), (60.0, 120.0)]), ("s2", 1, [(60.0, 60.0), (119.0, 119.0)])]
    df = spark.createDataFrame(lines, LINES)
    wanted = brute(lines)
    for cell, block in ((50.0, 512), (7.0, 512), (500.0, 4)):
        found = noding.noded(df, 0.0, cell, block).cache()
        assert pieces(found) == wanted
        parts = {}
        for r in found.collect():
            parts.setdefault(r.line_id, []).append(r.part)
        assert all(sorted(p) == list(range(len(p))) for p in parts.values())
    total = df.select(F.sum(noding.line_length(F.col("points")))).first()[0]
    assert found.agg(F.sum("length")).first()[0] == pytest.approx(total)
    assert noding.noded(df.limit(0)).count() == 0


def test_three_lines_through_one_point_and_repeated_rows(spark):
    star = [("a", 0, [(-10.0, 0.0), (10.0, 0.0)]), ("b", 0, [(0.0, -10.0), (0.0, 10.0)]), ("c", 0, [(-10.0, -10.0), (10.0, 10.0)]), ("p", 0, [(1.0, 1.0), (1.0, 1.0)]), ("q", 0, [(5.0, 5.0)])]
    found = noding.noded(spark.createDataFrame(star, LINES), 0.0)
    degrees = {r.node: r.degree for r in graphs.node_degrees(found).collect()}
    assert found.count() == 6 and degrees["0,0"] == 6


def test_dead_ends(spark):
    lines = [("road", 0, [(0.0, 0.0), (100.0, 0.0)]), ("stub", 0, [(40.0, 1.5), (40.0, 30.0)]), ("e1", 0, [(200.0, 0.0), (250.0, 0.0)]), ("e2", 0, [(251.0, 0.0), (300.0, 0.0)]), ("far", 0, [(40.0, 33.0), (40.0, 60.0)])]
    found = noding.noded(spark.createDataFrame(lines, LINES)).collect()
    ties = {frozenset((r.a, r.b)) for r in found if r.kind == "tie"}
    assert ties == {frozenset(("40000,1500", "40000,0")), frozenset(("250000,0", "251000,0"))}
    assert sorted((r.part, r.a, r.b) for r in found if r.line_id == "road") == [(0, "0,0", "40000,0"), (1, "40000,0", "100000,0")]


def test_blocked_directions(spark):
    edges = spark.createDataFrame([("with", straight(21)), ("against", straight(21)[::-1]), ("across", [(50.0, -3.0), (50.0, 1.0)]), ("off", straight(21, y0=90.0))], f"line_id string, points {XY}")
    trail = lambda role, two_way: spark.createDataFrame([("t", straight(41, x0=-100.0), role, two_way)], f"line_id string, points {XY}, role string, two_way boolean")
    told = lambda *t: {r.line_id: (r.connector, r.blocked) for r in noding.overlaid(edges, trail(*t)).collect()}
    assert told("downhill", False) == {"with": (False, "backward"), "against": (False, "forward"), "across": (False, None)}
    assert told("uphill", False)["with"] == (True, "backward")
    assert told("connector", False)["with"] == (True, None) and told("downhill", True)["against"] == (False, None)


def test_connector_is_joined_where_it_crosses(spark):
    edges = spark.createDataFrame([("r1", [(100.0, -40.0), (100.0, 40.0)]), ("r2", [(-5.0, -20.0), (-5.0, 20.0)]), ("r3", [(350.0, 0.0), (350.0, 50.0)])], f"line_id string, points {XY}")
    found = noding.with_connectors(edges, spark.createDataFrame([("c", straight(21))], f"line_id string, points {XY}")).collect()
    own = sorted((r.part, r.a, r.b) for r in found if r.kind == "connector")
    assert [p[1:] for p in own] == [("0,0", "85000,0"), ("85000,0", "100000,0"), ("100000,0", "115000,0"), ("115000,0", "200000,0")]
    links = {(r.a, r.b) for r in found if r.kind == "link"}
    assert links == {("0,0", "-5000,0"), ("85000,0", "100000,0"), ("115000,0", "100000,0"), ("200000,0", "100000,0")}
    assert sorted((r.a, r.b) for r in found if r.line_id == "r1") == [("100000,-40000", "100000,0"), ("100000,0", "100000,40000")]
    assert sum(r.line_id == "r3" for r in found) == 1


def test_equal_ways_have_the_least_edge_whatever_the_rounds(spark):
    edges = spark.createDataFrame([(1, 2, 1.0, 5), (2, 3, 1.0, 6), (3, 4, 3.0, 9), (1, 5, 1.0, 2), (5, 6, 1.0, 3), (6, 7, 1.0, 4), (7, 4, 2.0, 1), (4, 8, 0.0, 7), (8, 4, 0.0, 0)], "a int, b int, cost double, edge_id int")
    source = spark.createDataFrame([(1,)], "source int")
    for hops in (1, 2, 3, 4):
        best = {r.node: (r.cost, r.via) for r in graphs.cheapest_from(edges, source, hops=hops).collect()}
        assert best[4] == (5.0, 1) and best[8] == (5.0, 7)


def test_cycle_of_one_age_keeps_a_link(spark):
    links = spark.createDataFrame([(1, 2, False), (2, 1, False), (3, 1, True)], "node int, target int, flip boolean")
    left = graphs.without_cycles(links, F.lit(7))
    assert {(r.node, r.target) for r in left.collect()} == {(2, 1), (3, 1)}


def test_sections_and_medians(spark):
    sections = spark.createDataFrame([("r", 0.0, 10.0, "a"), ("r", 10.0, 20.0, "b"), ("r", 25.0, 30.0, None)], "route_id string, start_m double, stop_m double, name string")
    fixes = spark.createDataFrame([("r", 1, 0.0), ("r", 2, 10.0), ("r", 3, 22.0), ("r", 4, -1.0), ("r", 5, 26.0), ("x", 6, 1.0)], "route_id string, seq int, done_m double")
    assert {r.seq: (r["name"], r.next_name) for r in routes.sections_at(fixes, sections).collect()} == {1: ("a", "b"), 2: ("b", None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}
    rng = random.Random(3)
    values = [(g, rng.choice([0.0, -3.5, 2.0, rng.uniform(-9, 9), rng.uniform(-1e6, 1e6)])) for g in "abcde" for _ in range(ord(g) - 90)] + [("f", 4.0), ("g", None)]
    df = spark.createDataFrame(values, "g string, v double")
    wanted = {r.g: r.m for r in df.groupBy("g").agg(groups.true_median(F.col("v")).alias("m")).filter("m is not null").collect()}
    assert {r.g: r["median"] for r in groups.true_median_of_groups(df, ["g"], "v").collect()} == pytest.approx(wanted)
    report = {r.band: (r.n, r.downhill, r.middle) for r in accounts.tracks_report(spark.createDataFrame([(1.0, 1.0, 9.0), (2.0, 1.0, 1.0), (9.0, 1.0, 1.0)], "length double, gain double, loss double"), [5.0]).collect()}
    assert report == {0: (2, 1, 1.5), 1: (1, 0, 9.0)}
