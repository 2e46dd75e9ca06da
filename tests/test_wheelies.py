"""Wheelies against the rule over lists."""

import math
import random
import statistics

import pytest

from trailmill.operators.wheelies import RollingMedian, degrees_between, unit, wheelies

SCHEMA = "ride_id string, t double, x double, y double, z double, speed_kmh double"


def by_lists(rows, tilt, least, window, warm_up, every, longest):
    base, level, since, start, out = None, [], 0, None, []
    for t, x, y, z, kmh in rows:
        v, riding = (x, y, z), kmh is not None and kmh > 8.0
        angle = 0.0 if base is None else degrees_between(unit(v), base)
        if start is not None:
            if riding and angle >= tilt - 5:
                last, peak = t, max(peak, angle)
                speeds.append(kmh / 3.6)
                if t - start > longest:
                    start, base, level, since = None, None, [], 0
                continue
            if last - start >= least:
                out.append((start, last - start, sum(speeds) / len(speeds) * (last - start), peak))
            start = None
            continue
        if riding and base is not None and angle >= tilt:
            start = last = t
            peak, speeds = angle, [kmh / 3.6]
            continue
        if riding and angle < tilt - 5:
            level = (level + [v])[-window:]
            if len(level) >= warm_up:
                since += 1
                if base is None or since >= every:
                    since, base = 0, unit(tuple(statistics.median(s[k] for s in level) for k in range(3)))
    return out


def ride(seed, n=900):
    rng = random.Random(seed)
    rows, tilt, speed = [], 0.0, 20.0
    for k in range(n):
        if rng.random() < 0.03:
            tilt = rng.choice([0.0, 0.0, 8.0, 12.0, 25.0, 40.0])
        if rng.random() < 0.02:
            speed = rng.choice([None, 3.0, 15.0, 30.0])
        a = math.radians(tilt + rng.uniform(-2, 2))
        rows.append((k * 0.1, 9.8 * math.sin(a), rng.uniform(-0.3, 0.3), 9.8 * math.cos(a), speed))
    return rows


@pytest.mark.parametrize("batch", [7, 10_000])
def test_wheelies_do_not_depend_on_batches(spark, batch):
    settings = {"window": 40, "warm_up": 12, "every": 4, "longest_s": 6.0}
    rides = {f"r{k}": ride(k) for k in range(4)}
    rows = [(r, *s) for r, samples in rides.items() for s in samples]
    rows += [(None, 0.0, 1.0, 1.0, 1.0, 1.0), ("r0", None, 1.0, 1.0, 1.0, 9.0), ("r0", 1.0, None, 1.0, 1.0, 9.0), ("short", 0.0, 1.0, 0.0, 0.0, 20.0)]
    random.Random(1).shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = wheelies(spark.createDataFrame(rows, SCHEMA), 15.0, 0.3, **settings).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = [(r, *w) for r, samples in rides.items() for w in by_lists(samples, 15.0, 0.3, 40, 12, 4, 6.0)]
    told = sorted(map(tuple, found))
    assert len(expected) > 10 and [w[0] for w in told] == [w[0] for w in sorted(expected)]
    assert [w[1:] for w in told] == [pytest.approx(w[1:]) for w in sorted(expected)]


def test_wheelies_of_no_samples(spark):
    assert wheelies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rolling_median():
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.0, 2.5, rng.random()]) for _ in range(300)]
    median = RollingMedian(9)
    for k, v in enumerate(values):
        median.add(v)
        assert median.median() == statistics.median(values[max(0, k - 8) : k + 1])
