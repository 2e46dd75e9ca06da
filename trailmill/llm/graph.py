"""Connected components of an edge table, as joins and groupings that repeat until all stars are flat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import packed, saved


#: A node is a hub if it has more than this share of all edges, so that hubs number 2 / HUB_SHARE at most.
HUB_SHARE, HUB_LEAST = 0.001, 64
#: So few edges are no load even where one task gets them all, so their hubs are not set apart.
FEW = 100_000


def beside_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges joined with (a, m, degree) on a: hubs, whose number is bounded, by broadcast, all others by shuffle."""
    if n <= FEW:
        return edges.join(least, "a")
    bar = max(HUB_LEAST, int(n * HUB_SHARE))
    hubs = F.broadcast(least.filter(F.col("degree") > bar))
    rest = edges.join(F.broadcast(least.filter(F.col("degree") > bar).select("a")), "a", "left_anti")
    return edges.join(hubs, "a").unionByName(rest.join(least.filter(F.col("degree") <= bar), "a"))


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours hang on its smallest neighbour (or on itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
    return beside_least(both.filter("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours hang on the smallest of these; edges point down (a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    moved = beside_least(edges, least, n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) for each node a that is not the smallest of its component, b being the smallest.

    ``edges`` holds columns a and b of one orderable type, in any direction, repeats allowed. Nodes
    without an edge do not appear. Alternates large and small stars; both only ever group with partial
    aggregation; in joins the few hubs are broadcast, so that no task gets all edges of one node.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "star")
    seen = mark(now)
    if not seen[0]:
        return now
    for _ in range(most_rounds):
        now = saved(packed(small_star(large_star(now, seen[0]), seen[0]), seen[0]), "star")
        before, seen = seen, mark(now)
        if seen == before:
            return now
    raise RuntimeError("components did not settle")


def mark(edges: DataFrame) -> tuple:
    """Count and checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
