import random

from pyspark.sql import functions as F

import pytest

from trailmill.operators import sequences as S


def plain(left, right, flavour):
    out = {}
    for k, key, t in left:
        own = sorted((rt, v) for rk, rt, v in right if rk == key)
        before, after = [x for x in own if x[0] <= t], [x for x in own if x[0] >= t]
        if flavour == "hold":
            out[k] = before[-1][1] if before else None
        elif flavour == "clamp":
            out[k] = before[-1][1] if before else own[0][1] if own else None
        elif not before or not after:
            out[k] = before[-1][1] if before else after[0][1] if after else None
        else:
            (t0, v0), (t1, v1) = before[-1], after[0]
            out[k] = v0 if t0 == t else v0 + (v1 - v0) * (t - t0) / (t1 - t0)
    return out


@pytest.mark.parametrize("flavour", ["hold", "clamp", "linear"])
@pytest.mark.parametrize("bucket", [None, 7.0])
def test_as_of(spark, flavour, bucket):
    rng = random.Random(5)
    left = [(k, rng.choice("abc"), rng.randint(0, 100)) for k in range(60)]
    right = [(rng.choice("ab"), t, float(rng.randint(0, 9))) for t in rng.sample(range(100), 25)]
    found = S.as_of(spark.createDataFrame(left, "k int, key string, t long"), spark.createDataFrame(right, "key string, t long, v double"), "key", "t", "v", flavour, bucket)
    assert {r.k: r.v_at for r in found.collect()} == pytest.approx(plain(left, right, flavour))


@pytest.mark.parametrize("bucket", [None, 7.0])
def test_as_of_takes_the_last_of_equal_times(spark, bucket):
    right = [("a", 10, 5.0, 1), ("a", 10, 1.0, 2), ("a", 20, 2.0, 1), ("a", 20, 9.0, 3), ("a", 20, 4.0, 2)]
    left = [(0, "a", 5), (1, "a", 10), (2, "a", 15), (3, "a", 20), (4, "a", 25)]
    found = S.as_of(spark.createDataFrame(left, "k int, key string, t long"), spark.createDataFrame(right, "key string, t long, v double, no int"), "key", "t", "v", "linear", bucket, tie="no")
    assert {r.k: r.v_at for r in found.collect()} == {0: 1.0, 1: 1.0, 2: 5.0, 3: 9.0, 4: 9.0} and sorted(found.columns) == ["k", "key", "t", "v_at"]


def test_sessions_with_gaps_and_caps(spark):
    events = [(k, "a", t) for k, t in enumerate([0, 5, 9, 14, 19, 24, 40, 41, 100])]
    found = S.capped_sessions(spark.createDataFrame(events, "id int, key string, t long"), "key", "t", "id", 10, 20)
    assert {r.t: r.session for r in found.collect()} == {0: 0, 5: 0, 9: 0, 14: 0, 19: 0, 24: 1, 40: 2, 41: 2, 100: 3}


def test_order_of_the_whole_table(spark):
    from trailmill.operators.groups import in_order_of_all, limit_by_running_sum, pairs_within

    rng = random.Random(5)
    rows = [(k, rng.choice([None, 1, 2, 3]), rng.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, rank int, w long").repartition(3)
    found = {r.id: (r["__place"], r["__upto"]) for r in in_order_of_all(df, [F.desc_nulls_last("rank"), F.asc("id")], "w").collect()}
    total = 0
    for place, (k, _, w) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1):
        total += w
        assert found[k] == (place, total)
    assert limit_by_running_sum(df, [F.asc("id")], "w", 50).count() == sum(sum(w for _, _, w in rows[: k + 1]) <= 50 for k in range(500))
    assert in_order_of_all(df.filter("id < 0"), [F.asc("id")]).count() == 0
    pairs = pairs_within(df.withColumn("half", F.col("id") % 2).filter("id < 60"), "half", "id", block=4)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(a, b) for a in range(60) for b in range(a + 1, 60) if (a - b) % 2 == 0]
