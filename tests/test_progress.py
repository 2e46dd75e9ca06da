"""Replays and route progress against loops over the rows in order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trailmill.operators import progress as P
from trailmill.operators import replay as Y

XY = "array<struct<x:double,y:double>>"


def run_in_order(recordings, pairs, reps):
    """Trail of each recording, one after another, and the trails that each one matched."""
    score = {}
    for a, b, s in pairs:
        score[a, b] = score[b, a] = max(s, score.get((a, b), 0))
    trails, of, matched = [], {}, {}
    for rid, quality in recordings:
        found = {}
        for k, members in enumerate(trails):
            pool = sorted(members, key=lambda m: -m[1])
            scores = [score[rid, m] for m, _ in (pool if reps is None else pool[:reps]) if (rid, m) in score]
            if scores:
                found[k] = max(scores)
        k = max(found, key=lambda t: (found[t], -t)) if found else len(trails)
        if not found:
            trails.append([])
        trails[k].append((rid, quality))
        of[rid], matched[rid] = trails[k][0][0], {trails[t][0][0] for t in found}
    return of, matched


@pytest.mark.parametrize("reps", [1, 2, None])
def test_replay_is_the_run_in_order(spark, reps):
    rng = random.Random(reps or 7)
    recordings = [(k, rng.choice([0.1, 0.4, 0.6]), f"n{rng.randrange(9)}") for k in range(70)]
    pairs = [(a, b, rng.choice([0.8, 0.85, 0.9, 1.0])) for a in range(70) for b in range(a) if (a // 25 == b // 25) and rng.random() < 0.15]
    rng.shuffle(pairs)
    rows = spark.createDataFrame(recordings, "recording_id int, quality double, name string").repartition(3)
    found, matched = Y.replayed(rows, spark.createDataFrame(pairs, "a int, b int, score double"), [F.asc("recording_id")], reps)
    of, matches = run_in_order([r[:2] for r in recordings], pairs, reps)
    assert {r.recording_id: r.trail_id for r in found.collect()} == of
    told = {}
    for place, trail in matched.collect():
        told.setdefault(place - 1, set()).add(trail - 1)
    assert told == {k: v for k, v in matches.items() if v}
    stats = Y.replay_statistics(found, matched, "name").first()
    first = {}
    for rid, _, name in recordings:
        first.setdefault(name, []).append(of[rid])
    many = [v for v in first.values() if len(v) > 1]
    assert (stats.contributed, stats.trails, stats.attached) == (70, len(set(of.values())), 70 - len(set(of.values())))
    assert stats.twin_events == sum(len(v) > 1 for v in matches.values())
    assert stats.twin_pairs == len({(a, b) for v in matches.values() for a in v for b in v if a < b})
    assert (stats.name_groups, stats.name_split) == (len(many), sum(t != v[0] for v in many for t in v))


def test_replay_without_pairs_and_rows(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.1)], "recording_id int, quality double")
    pairs = spark.createDataFrame([], "a int, b int, score double")
    found, matched = Y.replayed(rows, pairs, [F.asc("recording_id")], 1)
    assert {r.recording_id: r.trail_id for r in found.collect()} == {1: 1, 2: 2} and matched.collect() == []
    assert Y.replayed(rows.filter("recording_id > 5"), pairs, [F.asc("recording_id")], 1)[0].collect() == []


def followed(route, fixes):
    """Way and distance of each fix, one after another, over all segments."""
    out, last = [], 0.0
    for x, y in fixes:
        start, feet = 0.0, []
        for (ax, ay), (bx, by) in zip(route, route[1:]):
            dx, dy = bx - ax, by - ay
            own2 = dx * dx + dy * dy
            t = min(1.0, max(0.0, -((ax - x) * dx + (ay - y) * dy) / own2)) if own2 else 0.0
            feet.append((start + t * math.sqrt(own2), math.hypot(ax - x + t * dx, ay - y + t * dy)))
            start += math.sqrt(own2)
        near = [f for f in feet if last - 30 <= f[0] <= last + 800]
        window, whole = min(near, key=lambda f: f[1], default=None), min(feet, key=lambda f: f[1])
        if window is not None and window[1] <= 30:
            here = window
        elif whole[1] <= 30 or window is None:
            here = whole
        else:
            here = (window[0], whole[1])
        last = here[0]
        out.append(here)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 16, 4096])
def test_chunk_ends_change_no_progress(spark, chunk):
    rng = random.Random(4)
    routes, fixes, expected = [], [], {}
    for ride in ("a", "b"):
        out = [(k * 90.0, rng.uniform(-40, 40)) for k in range(16)]
        route = out + [(x, y + 6) for x, y in reversed(out)] + [(x, y - 400) for x, y in out] + [out[0], out[0]]
        at = [(rng.uniform(-3, 3) + x, rng.uniform(-9, 9) + y) for x, y in route[:40]] + [(9e3, 9e3)] * 3 + [(out[7][0], out[7][1] + 2)] * 2 + [(out[3][0], 60.0)] * 4
        routes.append((ride, route))
        fixes += [(ride, k, x, y) for k, (x, y) in enumerate(at)]
        expected[ride] = followed(route, at)
    fixes += [("none", 0, 1.0, 1.0), ("a", 99, None, 1.0)]
    rows = spark.createDataFrame(fixes, "ride_id string, seq int, x double, y double").repartition(3)
    found = P.route_progress(rows, spark.createDataFrame(routes, f"line_id string, points {XY}"), chunk).orderBy("ride_id", "seq").collect()
    assert {r.ride_id for r in found} == {"a", "b"}
    for ride, told in expected.items():
        assert [(r.done_m, r.off_m) for r in found if r.ride_id == ride] == [pytest.approx(t, abs=1e-6) for t in told]


def test_progress_out_and_back(spark):
    loop = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 5.0), (0.0, 5.0)]
    fixes = spark.createDataFrame([("r", k, x, 2.4) for k, x in enumerate((10.0, 300.0, 700.0, 990.0))] + [("r", 4, 990.0, 2.6), ("r", 5, 600.0, 2.4)], "ride_id string, seq int, x double, y double")
    found = P.route_progress(fixes, spark.createDataFrame([("r", loop)], f"line_id string, points {XY}"), 2).orderBy("seq").collect()
    assert [r.done_m for r in found] == [10.0, 300.0, 700.0, 990.0, 1015.0, 1405.0]


def test_replays_of_one_order_go_through_the_same_rounds(spark, monkeypatch):
    from trailmill.plans import replay_queries

    calls, labels = [], Y.component_labels
    monkeypatch.setattr(Y, "component_labels", lambda edges: calls.append(1) or labels(edges))
    rows = spark.createDataFrame([(k, float(k), [0.1, 0.6][k % 2], "n") for k in range(12)], "recording_id long, c_acctbal double, quality double, name string")
    pairs = spark.createDataFrame([(k, k + 1, 0.9 - k / 100) for k in range(11)], "a long, b long, score double")
    monkeypatch.setattr(replay_queries, "recordings", lambda *_: rows)
    monkeypatch.setattr(replay_queries, "same_lines", lambda *_: pairs)
    found = {n: {r.recording_id: r.trail_id for r in told.collect()} for n, (_, told, _) in zip(replay_queries.REPS, replay_queries.replays(spark, ""))}
    alone = {n: {r.recording_id: r.trail_id for r in Y.replayed(rows, pairs, [F.asc("recording_id")], n)[0].collect()} for n in replay_queries.REPS}
    assert found == alone and len(calls) == 4  # one for all replays together, and one for each alone
