"""Graph operators: components, chains of merges, road graphs, cheapest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import saved


def resolved_chains(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root, flip: where chains of (node, target, flip) end, by pointer jumping; flips along the way combine.

    Each node has at most one target and chains have no cycle (see ``without_cycles``). The work halves the
    remaining length in each round.
    """
    now = saved(links.select("node", F.col("target").alias("root"), "flip"), "chains")
    for _ in range(most_rounds):
        nxt = now.select(F.col("node").alias("root"), F.col("root").alias("__root"), F.col("flip").alias("__flip"))
        joined = now.join(nxt, "root", "left")
        if joined.filter("__root is not null").isEmpty():
            return now
        now = saved(joined.select("node", F.coalesce("__root", "root").alias("root"), (F.col("flip") != F.coalesce("__flip", F.lit(False))).alias("flip")), "chains")
    raise RuntimeError("chains do not end; remove cycles first")


def without_cycles(links: DataFrame, age: Column, most_rounds: int = 64) -> DataFrame:
    """(node, target, flip) without the links that close cycles: the link of the oldest node of each cycle goes.

    ``age`` orders nodes (smaller is older; of one age the smaller node). Walks double their length each round and carry the least age on their way; those that
    run off a chain's end go. Once neither the nodes that walks reach nor the ages change, what they reach are the
    nodes on cycles, whatever their length.
    """
    aged = saved(links.withColumn("age", F.struct(age.alias("age"), F.col("node").alias("node"))), "links")
    now = saved(aged.join(aged.select(F.col("node").alias("target")), "target", "left_semi").select("node", F.col("target").alias("at"), F.col("age").alias("least")), "links")
    seen = walked(now)
    for _ in range(most_rounds):
        if not seen[0]:
            return aged.drop("age")
        now = saved(now.join(now.select(F.col("node").alias("at"), F.col("at").alias("__to"), F.col("least").alias("__least")), "at").select("node", F.col("__to").alias("at"), F.least("least", "__least").alias("least")), "links")
        before, seen = seen, walked(now)
        if seen == before:
            on_cycle = now.join(now.select(F.col("at").alias("node")).distinct(), "node", "left_semi")
            oldest = on_cycle.join(aged.select("node", "age"), "node").filter("node = least.node").select("node")
            return aged.join(oldest, "node", "left_anti").drop("age")
    raise RuntimeError("walks did not settle")


def walked(walks: DataFrame) -> tuple:
    """How many walks there are, how many nodes they reach, and a checksum of the ages."""
    return tuple(walks.agg(F.count("*"), F.count_distinct("at"), F.sum(F.xxhash64("node", "least").cast("decimal(20,0)"))).first())


def component_labels(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) of all nodes of undirected edges (a, b): least labels spread and jump ahead."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.toDF("b", "__label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("__label").alias("__near"))
        spread = labels.join(near, "node").withColumn("component", F.least("component", "__near")).select("node", "component")
        jumped = spread.join(labels.toDF("component", "__next"), "component", "left").select("node", F.least("component", F.coalesce("__next", "component")).alias("component"))
        after = saved(jumped, "labels")
        changed = not after.join(labels, ["node", "component"], "left_anti").isEmpty()
        labels = after
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")


def component_sizes(edges: DataFrame, weight: str) -> DataFrame:
    """component, edges, total, share: components of (a, b, weight), the longest first by total."""
    labels = component_labels(edges)
    sums = edges.join(labels.toDF("a", "component"), "a").groupBy("component").agg(F.count("*").alias("edges"), F.sum(weight).alias("total"))
    return sums.crossJoin(sums.agg(F.sum("total").alias("__all"))).withColumn("share", F.col("total") / F.col("__all")).drop("__all")


def cheapest_from(edges: DataFrame, sources: DataFrame, limit: float = float("inf"), most_rounds: int = 1000, hops: int = 3) -> DataFrame:
    """source, node, cost, via: the cheapest way from each source to all nodes within a cost limit.

    ``edges`` are directed (a, b, cost, edge_id), ``sources`` (source). Each round relaxes the edges out of the
    nodes that the last round improved, ``hops`` edges far and for all sources at once, before the best ways are written again;
    ``via`` is the last edge: of all that end a cheapest way, come from a cheaper node and are no loop, the one with the smallest id. A
    node that only free edges reach at its cost keeps the edge that found it first, so that walks back end.
    """
    edges = saved(edges.select("a", "b", "cost", "edge_id"), "paths")
    kind = dict(edges.dtypes)["edge_id"]
    best = saved(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast(kind).alias("via"), F.lit(1).alias("fresh")), "paths")
    least = F.min(F.struct("cost", "fresh", "via")).alias("m")
    for _ in range(most_rounds):
        front, all_ways = best.filter("fresh > 0"), best.withColumn("fresh", F.lit(0))
        for hop in range(hops):
            out = front.select("source", F.col("node").alias("a"), F.col("cost").alias("__cost")).join(edges, "a")
            tried = out.select("source", F.col("b").alias("node"), (F.col("__cost") + F.col("cost")).alias("cost"), F.col("edge_id").alias("via"), F.lit(hop + 1).alias("fresh")).filter(F.col("cost") <= limit)
            front = tried.groupBy("source", "node").agg(least).select("source", "node", "m.cost", "m.via", "m.fresh")
            all_ways = all_ways.unionByName(front)
        # of equal costs the way found first stays, so that rounds end
        best = saved(all_ways.groupBy("source", "node").agg(least).select("source", "node", "m.cost", "m.via", "m.fresh"), "paths")
        if best.filter("fresh > 0").isEmpty():
            return with_least_edges(best.drop("fresh"), edges)
    raise RuntimeError("paths did not settle")


def with_least_edges(best: DataFrame, edges: DataFrame) -> DataFrame:
    """Settled ways (source, node, cost, via) with the smallest edge that ends a cheapest way as ``via``, whatever round found it."""
    before = best.select("source", F.col("node").alias("a"), F.col("cost").alias("__before"))
    ends = before.join(edges, "a").select("source", F.col("b").alias("node"), "__before", (F.col("__before") + F.col("cost")).alias("cost"), "edge_id")
    tight = ends.filter(F.col("__before") < F.col("cost")).groupBy("source", "node", "cost").agg(F.min("edge_id").alias("__via"))
    return best.join(tight, ["source", "node", "cost"], "left").select("source", "node", "cost", F.coalesce("__via", "via").alias("via"))


def walked_back(best: DataFrame, edges: DataFrame, goals: DataFrame, most_rounds: int = 64) -> DataFrame:
    """source, goal, back, edge_id: the edges of each cheapest path, numbered from the goal back.

    Each round jumps twice as far from all places found so far, so a path of n edges takes log2(n) rounds.
    """
    ends = edges.select(F.col("edge_id").alias("via"), F.col("a").alias("up"), F.col("b").alias("node"))
    step = saved(best.filter("via is not null").join(ends, ["via", "node"]).select("source", "node", "via", "up"), "walk")
    jump, found = step.select("source", "node", "up"), saved(goals.select("source", "goal", F.lit(0).alias("back"), F.col("goal").alias("node")), "walk")
    for k in range(most_rounds):
        hop = saved(found.join(jump, ["source", "node"]).select("source", "goal", (F.col("back") + (1 << k)).cast("int").alias("back"), F.col("up").alias("node")), "walk")
        if hop.isEmpty():
            return found.join(step, ["source", "node"]).select("source", "goal", "back", F.col("via").alias("edge_id"))
        found = found.unionByName(hop)
        jump = saved(jump.join(jump.select("source", F.col("node").alias("up"), F.col("up").alias("__up")), ["source", "up"]).select("source", "node", F.col("__up").alias("up")), "walk")
    raise RuntimeError("paths do not end")


def road_graph(lines: DataFrame) -> DataFrame:
    """edges (line_id, part, a, b, points, length) from lines (line_id, points of lat and lon).

    Vertices that occur at least twice, by micro-degree, and line ends are nodes; lines are cut there. Cuts are numbered by a running sum, so
    that a vertex at a cut ends one edge and begins the next.
    """
    from ..functions.geo import track_length

    key = lambda p: F.concat_ws(",", F.round(p["lat"] * 1e6).cast("long").cast("string"), F.round(p["lon"] * 1e6).cast("long").cast("string"))
    vertices = lines.select("line_id", F.size("points").alias("n"), F.posexplode("points").alias("pos", "p")).withColumn("key", key(F.col("p")))
    shared = vertices.groupBy("key").agg((F.count("*") > 1).alias("shared"))
    marked = vertices.join(shared, "key").withColumn("cut", F.col("shared") | (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1))
    over = W.partitionBy("line_id").orderBy("pos")
    numbered = marked.withColumn("part", F.sum(F.col("cut").cast("int")).over(over.rowsBetween(W.unboundedPreceding, -1)))
    ends = numbered.filter(F.col("cut") & (F.col("pos") < F.col("n") - 1)).withColumn("part", F.coalesce("part", F.lit(0)) + 1)
    pieces = numbered.filter("part is not null").select("line_id", "part", "pos", "p", "key").unionByName(ends.select("line_id", "part", "pos", "p", "key"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "p", "key")))
    edges = pieces.groupBy("line_id", "part").agg(rows.alias("r")).select("line_id", (F.col("part") - 1).alias("part"), F.col("r")[0]["key"].alias("a"), F.element_at("r", -1)["key"].alias("b"), F.transform("r", lambda x: x["p"]).alias("points"))
    return edges.withColumn("length", track_length(F.col("points")))


def node_degrees(edges: DataFrame) -> DataFrame:
    """node, degree of undirected edges (a, b)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def nearest_edges(points: DataFrame, edges: DataFrame, reach: float, k: int = 4) -> DataFrame:
    """The k nearest edges (line_id of the edge table's lines) of each point (point_id, x, y) within reach: point_id, other_id, d, place; of equally near ones the smaller id."""
    from .matching import in_micrometres, near_points

    found = near_points(points.select(F.col("point_id").alias("line_id"), F.lit(0).alias("pos"), "x", "y"), edges, reach, F.lit(True))
    place = F.row_number().over(W.partitionBy("line_id").orderBy(in_micrometres("d"), "other_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select(F.col("line_id").alias("point_id"), "other_id", "d", "place")
