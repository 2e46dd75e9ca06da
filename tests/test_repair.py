import random

import pytest

from trailmill.operators import graphs, repair


def ways(df):
    return {(r.source, r.node): (r.cost, r.via) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_a_fresh_run(spark, seed):
    rng = random.Random(seed)
    n = 150
    rows = [(a, b, float(rng.randint(1, 9)), k) for k, (a, b) in enumerate((rng.randrange(n), rng.randrange(n)) for _ in range(420))]
    edges = spark.createDataFrame(rows, "a long, b long, cost double, edge_id long")
    sources = spark.createDataFrame([(0,), (1,), (2,)], "source long")
    best = graphs.cheapest_from(edges, sources, 40.0).cache()
    picked = rng.sample(range(420), 12)
    changes = spark.createDataFrame([(k, rng.choice([None, rows[k][2] + 3.0, rows[k][2] / 2])) for k in picked] + [(9999, 1.0)], "edge_id long, cost double")
    found, touched = repair.repaired(best, edges, changes, 40.0)
    assert ways(found) == ways(graphs.cheapest_from(repair.changed_edges(edges, changes), sources, 40.0))
    assert 0 < touched.count() < best.count()


def test_a_closed_chain_and_nothing_to_do(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0, k) for k in range(30)] + [(0, 20, 50.0, 100)], "a long, b long, cost double, edge_id long")
    best = graphs.cheapest_from(edges, spark.createDataFrame([(0,)], "source long")).cache()
    closed = spark.createDataFrame([(9, None)], "edge_id long, cost double")
    lost = repair.cut_off(best, edges, edges.filter("edge_id = 9").select("edge_id", "b"))
    assert sorted(r.node for r in lost.collect()) == list(range(10, 31))
    found = ways(repair.repaired(best, edges, closed)[0])
    assert found[0, 20] == (50.0, 100) and found[0, 30] == (60.0, 29) and (0, 10) not in found and found[0, 9] == (9.0, 8)
    none, touched = repair.repaired(best, edges, closed.limit(0))
    assert ways(none) == ways(best) and touched.count() == 0
