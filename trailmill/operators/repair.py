"""Cheapest ways kept up to date: after edges close or change their cost, only what hangs on them is searched again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import saved

KEYS = ["source", "node"]


def changed_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges (a, b, cost, edge_id) after changes (edge_id, cost; null closes an edge); changes of unknown edges do nothing."""
    told = changes.select("edge_id", F.col("cost").alias("__new"), F.lit(True).alias("__told"))
    return edges.join(told, "edge_id", "left").withColumn("cost", F.when(F.col("__told"), F.col("__new")).otherwise(F.col("cost"))).filter("cost is not null").select("a", "b", "cost", "edge_id")


def cut_off(best: DataFrame, edges: DataFrame, worse: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """source, node of all ways (source, node, cost, via) that run over one of the edges ``worse`` (edge_id, b): the subtrees below them.

    Each round goes from the ways found in the last one to those that go on from them, so only subtrees are joined.
    """
    front = saved(best.join(worse.select(F.col("edge_id").alias("via"), F.col("b").alias("node")), ["via", "node"], "left_semi").select(*KEYS), "cut-off")
    steps = edges.select(F.col("a").alias("__at"), F.col("b").alias("node"), F.col("edge_id").alias("via"))
    parts = [front]
    for _ in range(most_rounds):
        if front.isEmpty():
            return saved(union_of(parts).distinct(), "cut-off")
        below = front.withColumnRenamed("node", "__at").join(steps, "__at").select("source", "node", "via")
        # a way that a descent began with was entered already, so nothing is entered twice from above
        on = below.join(best.select("source", "node", "via"), ["source", "node", "via"], "left_semi").select(*KEYS)
        front = saved(on.join(parts[0], KEYS, "left_anti"), "cut-off")
        parts.append(front)
        if len(parts) > 16:
            parts = [parts[0], saved(union_of(parts[1:]), "cut-off")]
    raise RuntimeError("subtrees did not end")


def union_of(parts: list[DataFrame]) -> DataFrame:
    """All rows of some tables of the same columns."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def repaired(best: DataFrame, edges: DataFrame, changes: DataFrame, limit: float = float("inf"), most_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(ways, touched): what ``cheapest_from`` gives for the changed edges, from the ways (source, node, cost, via) that it gave before.

    Ways over closed or dearer edges are cut off with all that hangs on them, and their nodes are reached again from the ways that stay; cheaper edges begin
    from their start. Only improvements go from round to round. Then the least edge of equal ways is looked up again where a way, its predecessor or an
    edge into it changed: ``touched`` (source, node). Sources stay reached at no cost. A node that only free edges reach keeps an edge that reaches it.
    """
    told = changes.select("edge_id", F.col("cost").alias("__new"))
    hit = saved(edges.join(told, "edge_id").select("a", "b", "cost", "edge_id", "__new"), "changes")
    worse, better = hit.filter("__new is null or __new > cost"), hit.filter("__new < cost")
    now = saved(changed_edges(edges, changes), "repaired")
    lost = cut_off(best, edges, worse)
    kept = saved(best.join(lost, KEYS, "left_anti").select("source", "node", "cost", "via"), "repaired")
    start = kept.select("source", F.col("node").alias("a"), F.col("cost").alias("__before"))
    into_lost = lost.select("source", F.col("node").alias("b")).join(now, "b")
    cheaper = better.select("a", "b", F.col("__new").alias("cost"), "edge_id").join(start, "a")
    first = into_lost.join(start, ["source", "a"]).select("source", "b", "__before", "cost", "edge_id").unionByName(cheaper.select("source", "b", "__before", "cost", "edge_id"))
    tried = first.select("source", F.col("b").alias("node"), (F.col("__before") + F.col("cost")).alias("cost"), F.col("edge_id").alias("via"))
    least = F.min(F.struct("cost", "via")).alias("m")
    gained = kept.limit(0)
    for _ in range(most_rounds):
        one = tried.filter(F.col("cost") <= limit).groupBy(*KEYS).agg(least).select(*KEYS, "m.cost", "m.via")
        known = one.join(kept.select(*KEYS, F.col("cost").alias("__kept")), KEYS, "left").join(gained.select(*KEYS, F.col("cost").alias("__gained")), KEYS, "left")
        front = saved(known.filter((F.col("__kept").isNull() | (F.col("cost") < F.col("__kept"))) & (F.col("__gained").isNull() | (F.col("cost") < F.col("__gained")))).select(*KEYS, "cost", "via"), "gained")
        if front.isEmpty():
            break
        gained = saved(gained.unionByName(front).groupBy(*KEYS).agg(least).select(*KEYS, "m.cost", "m.via"), "gained")
        out = front.select("source", F.col("node").alias("a"), F.col("cost").alias("__before")).join(now, "a")
        tried = out.select("source", F.col("b").alias("node"), (F.col("__before") + F.col("cost")).alias("cost"), F.col("edge_id").alias("via"))
    else:
        raise RuntimeError("ways did not settle")
    ways = saved(kept.join(gained.select(*KEYS), KEYS, "left_anti").unionByName(gained), "repaired")
    moved = lost.unionByName(gained.select(*KEYS)).distinct()
    after = moved.withColumnRenamed("node", "a").join(edges.select("a", F.col("b").alias("node")), "a").select(*KEYS)
    ends = hit.select(F.col("b").alias("node")).distinct().join(ways.select(*KEYS), "node").select(*KEYS)
    touched = saved(union_of([moved, after, ends]).distinct(), "touched")
    before = ways.select("source", F.col("node").alias("a"), F.col("cost").alias("__before"))
    looked = touched.withColumnRenamed("node", "b").join(now, "b").join(before, ["source", "a"]).select("source", F.col("b").alias("node"), "__before", (F.col("__before") + F.col("cost")).alias("cost"), "edge_id")
    tight = looked.filter(F.col("__before") < F.col("cost")).groupBy(*KEYS, "cost").agg(F.min("edge_id").alias("__via"))
    told_again = ways.join(tight, [*KEYS, "cost"], "left").select(*KEYS, "cost", F.coalesce("__via", "via").alias("via"))
    return told_again, touched
