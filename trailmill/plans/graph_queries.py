"""Graph operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import groups as A
from ..operators import repair as P
from ..operators import setops as S
from .catalog import query, table
from .set_queries import FRIENDS, friend_edges


@query(
    f"""WITH RECURSIVE {FRIENDS}, r AS (SELECT me AS node, friend AS seen FROM f UNION SELECT me, me FROM f UNION SELECT r.node, f.friend FROM r JOIN f ON f.me = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node"""
)
def a33_components(spark, sf_dir):
    """Connected groups of friends, named by their smallest member."""
    edges = friend_edges(spark, sf_dir).select(F.col("requester").alias("a"), F.col("addressee").alias("b"))
    return G.component_labels(edges)


@query(
    """WITH RECURSIVE l AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 16 = 0 THEN NULL ELSE p_partkey - 1 - p_partkey % 3 * (p_partkey % 16 > 3)::INT END AS target, p_size % 2 = 1 AS flip FROM part),
r AS (SELECT node, target AS root, flip FROM l WHERE target IS NOT NULL UNION ALL SELECT r.node, l.target, r.flip <> l.flip FROM r JOIN l ON l.node = r.root WHERE l.target IS NOT NULL)
SELECT node, root, flip FROM r WHERE root % 16 = 0 AND root = (SELECT min(x.root) FROM r x WHERE x.node = r.node)"""
)
def m07_chains(spark, sf_dir):
    """Where chains of duplicates end, with their directions combined."""
    k = F.col("p_partkey")
    target = F.when(k % 16 != 0, k - 1 - k % 3 * (k % 16 > 3).cast("int"))
    links = table(spark, sf_dir, "part").select(k.alias("node"), target.alias("target"), (F.col("p_size") % 2 == 1).alias("flip")).filter("target is not null")
    return G.resolved_chains(links)


ROADS = """e AS (SELECT p_partkey AS a, (p_partkey * 3 + 1) % n AS b, p_size AS cost FROM part, c UNION ALL SELECT p_partkey, (p_partkey * 7 + 2) % n, p_size + 5 FROM part, c)"""


def roads(spark, sf_dir):
    """A directed graph over parts."""
    part = table(spark, sf_dir, "part")
    n = part.agg(F.count("*").alias("n"))
    both = part.crossJoin(F.broadcast(n))
    k = F.col("p_partkey")
    one = both.select(k.alias("a"), ((k * 3 + 1) % F.col("n")).alias("b"), F.col("p_size").cast("double").alias("cost"), (k * 2).alias("edge_id"))
    two = both.select(k.alias("a"), ((k * 7 + 2) % F.col("n")).alias("b"), (F.col("p_size") + 5).cast("double").alias("cost"), (k * 2 + 1).alias("edge_id"))
    return one.unionByName(two)


@query(
    f"""WITH RECURSIVE c AS (SELECT count(*) AS n FROM part), {ROADS},
p AS (SELECT s AS source, s AS node, 0::BIGINT AS cost FROM (VALUES (0), (17), (101)) v(s) UNION SELECT p.source, e.b, p.cost + e.cost FROM p JOIN e ON e.a = p.node WHERE p.cost + e.cost <= 120)
SELECT source::BIGINT AS source, node::BIGINT AS node, min(cost)::DOUBLE AS cost FROM p GROUP BY 1, 2"""
)
def r10_cheapest(spark, sf_dir):
    """The cheapest ways from three sources within a budget."""
    sources = spark.createDataFrame([(0,), (17,), (101,)], "source long")
    return G.cheapest_from(roads(spark, sf_dir), sources, 120.0).select("source", "node", "cost")


@query(
    f"""WITH RECURSIVE c AS (SELECT count(*) AS n FROM part), o AS (SELECT p_partkey AS a, (p_partkey * 3 + 1) % n AS b, p_size AS cost, CASE p_partkey % 9 WHEN 2 THEN NULL WHEN 5 THEN p_size + 20 WHEN 7 THEN p_size // 2 ELSE p_size END AS fresh FROM part, c UNION ALL SELECT p_partkey, (p_partkey * 7 + 2) % n, p_size + 5, p_size + 5 FROM part, c),
p AS (SELECT s AS source, s AS node, 0::BIGINT AS cost FROM (VALUES (0), (17), (101)) v(s) UNION SELECT p.source, o.b, p.cost + o.fresh FROM p JOIN o ON o.a = p.node WHERE p.cost + o.fresh <= 120)
SELECT source::BIGINT AS source, node::BIGINT AS node, min(cost)::DOUBLE AS cost FROM p GROUP BY 1, 2"""
)
def r18_repaired(spark, sf_dir):
    """The cheapest ways from three sources after edges were closed, made dearer and made cheaper, from those before."""
    edges, part = roads(spark, sf_dir), table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    cost = F.when(k % 9 == 5, size + 20).when(k % 9 == 7, F.floor(size / 2).cast("double"))
    changes = part.filter((k % 9).isin(2, 5, 7)).select((k * 2).alias("edge_id"), cost.alias("cost"))
    best = G.cheapest_from(edges, spark.createDataFrame([(0,), (17,), (101,)], "source long"), 120.0)
    return P.repaired(best, edges, changes, 120.0)[0].select("source", "node", "cost")


@query(
    """SELECT node, count(*) AS degree FROM (SELECT o_custkey AS node FROM orders UNION ALL SELECT o_orderkey % 1000 FROM orders) GROUP BY 1"""
)
def r22_degrees(spark, sf_dir):
    """Degrees of nodes."""
    return G.node_degrees(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1000).alias("b")))


@query(
    """SELECT l_suppkey AS a, l_partkey % 50 AS b, count(*) AS n, round(sum(l_quantity), 2) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS up FROM lineitem GROUP BY 1, 2"""
)
def a32_path_summary(spark, sf_dir):
    """Sums along paths."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("up"))


@query(
    f"""WITH {FRIENDS} SELECT a.me AS x, b.friend AS y, count(*) AS ways FROM f a JOIN f b ON a.friend = b.me AND a.me < b.friend WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.me = a.me AND f.friend = b.friend) GROUP BY 1, 2"""
)
def j41_two_hops(spark, sf_dir):
    """Friends of friends who are no friends yet."""
    f = S.symmetric(friend_edges(spark, sf_dir), "requester", "addressee")
    known = f.toDF("x", "y")
    return A.pairs_within(f.toDF("x", "via"), "via", "x").toDF("via", "x", "y").join(known, ["x", "y"], "left_anti").groupBy("x", "y").agg(F.count("*").alias("ways"))
