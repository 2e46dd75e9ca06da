"""Routes over a road graph: goals, via points, replanning, pools, sections, split edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import point_segment
from ..scratch import saved

# How much dearer a route may be that does not turn back, and the turn that counts as back.
BACK_S, BACK_DEGREES = 180.0, 100.0


def cheapest_between(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, speed: float, most_rounds: int = 1000, hops: int = 3) -> DataFrame:
    """source, goal, cost of the cheapest way of each pair, as far as there is one.

    ``edges`` are directed (a, b, cost), ``nodes`` (node, x, y) in metres; no edge is cheaper than its length at ``speed``, so a way
    whose cost and straight rest exceed the best way known to its goal is not followed. Each round goes ``hops`` edges further, from the
    source ahead and from the goal back; a pair is settled once one of both has nothing left to follow, so that a goal that few nodes
    lead to does not have all other nodes searched for a way.
    """
    place = nodes.select("node", "x", "y")
    ahead = edges.select("a", F.col("b").alias("node"), F.col("cost").alias("step")).join(place, "node")
    back = ahead.select(F.col("node").alias("a"), F.col("a").alias("node"), "step").join(place, "node", "left")
    columns = ["side", "a", "node", "step", "x", "y"]
    steps = saved(ahead.withColumn("side", F.lit(0)).select(columns).unionByName(back.withColumn("side", F.lit(1)).select(columns)), "routes")
    rest = F.coalesce(F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2) / speed, F.lit(0.0))
    keys = ["side", "source", "goal", "target", "tx", "ty", "node"]
    ends = pairs.select("source", "goal").join(place.toDF("goal", "gx", "gy"), "goal").join(place.toDF("source", "sx", "sy"), "source", "left")
    search = lambda side, start, target, x, y: F.struct(F.lit(side).alias("side"), "source", "goal", F.col(target).alias("target"), F.col(x).alias("tx"), F.col(y).alias("ty"), F.col(start).alias("node"))
    both = ends.select(F.inline(F.array(search(0, "source", "goal", "gx", "gy"), search(1, "goal", "source", "sx", "sy"))))
    best = saved(both.select(*keys, F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")), "routes")
    going = both.select("source", "goal").distinct()
    for _ in range(most_rounds):
        reached = best.filter("node = target").groupBy("source", "goal").agg(F.min("cost").alias("__best"))
        front, every = best.filter("fresh").join(going, ["source", "goal"], "left_semi").select(best.columns), best.withColumn("fresh", F.lit(False))
        for _ in range(hops):
            out = front.withColumnRenamed("node", "a").join(steps, ["side", "a"]).withColumn("cost", F.col("cost") + F.col("step"))
            hopeful = out.join(reached, ["source", "goal"], "left").filter(F.col("__best").isNull() | (F.col("cost") + rest < F.col("__best")))
            front = hopeful.groupBy(*keys).agg(F.min("cost").alias("cost")).withColumn("fresh", F.lit(True))
            every = every.unionByName(front)
        best = saved(every.groupBy(*keys).agg(F.min(F.struct("cost", "fresh")).alias("m")).select(*keys, "m.cost", "m.fresh"), "routes")
        going = best.filter("fresh").groupBy("source", "goal").agg(F.count_distinct("side").alias("n")).filter("n = 2").select("source", "goal")
        if going.isEmpty():
            return best.filter("node = target").groupBy("source", "goal").agg(F.min("cost").alias("cost"))
    raise RuntimeError("routes did not settle")


def through_vias(routes: DataFrame, edges: DataFrame, nodes: DataFrame, speed: float) -> DataFrame:
    """route_id, cost, legs of routes (route_id, stops): the cheapest ways from stop to stop; routes with a leg that has none are missing."""
    legs = routes.select("route_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda k: F.struct(F.get("stops", k - 1).alias("source"), F.get("stops", k).alias("goal")))).alias("l")).select("route_id", "l.source", "l.goal")
    found = cheapest_between(edges, legs.select("source", "goal").distinct(), nodes, speed)
    sums = legs.join(found, ["source", "goal"]).groupBy("route_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("legs"))
    return sums.join(routes.select("route_id", (F.size("stops") - 1).alias("__n")), "route_id").filter("legs = __n").drop("__n")


def points_back(edges: DataFrame, course: Column) -> DataFrame:
    """Edges (heading in degrees) that point back: more than 100 degrees off a course."""
    off = F.abs(F.pmod(F.col("heading") - course + 540, F.lit(360.0)) - 180)
    return edges.filter(off > BACK_DEGREES)


def replanned(free: DataFrame, onward: DataFrame) -> DataFrame:
    """source, goal, cost, turns: the way without edges that point back, unless there is none or turning saves more than 180 s."""
    both = free.select("source", "goal", F.col("cost").alias("__free")).join(onward.select("source", "goal", F.col("cost").alias("__on")), ["source", "goal"], "left")
    turns = F.col("__on").isNull() | (F.col("__on") - F.col("__free") > BACK_S)
    return both.select("source", "goal", F.when(turns, F.col("__free")).otherwise(F.col("__on")).alias("cost"), turns.alias("turns"))


def pool_of(trails: DataFrame, reach: float) -> DataFrame:
    """Trails (start_m, end_m, downhill, warns) with ``pool``: in-reach, warned, connector, or too-far if an end is beyond reach."""
    far = (F.col("start_m") > reach) | (F.col("end_m") > reach)
    return trails.withColumn("pool", F.when(far, "too-far").when(~F.col("downhill"), "connector").when(F.col("warns"), "warned").otherwise("in-reach"))


def class_sections(steps: DataFrame) -> DataFrame:
    """route_id, section, cls, metres: runs of one class along routes (route_id, pos, cls, metres), in order."""
    over = W.partitionBy("route_id").orderBy("pos")
    new = (~F.col("cls").eqNullSafe(F.lag("cls").over(over)) | (F.row_number().over(over) == 1)).cast("int")
    numbered = steps.withColumn("__new", new).withColumn("section", F.sum("__new").over(over.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("route_id", "section").agg(F.first("cls").alias("cls"), F.sum("metres").alias("metres"))


def sections_at(fixes: DataFrame, sections: DataFrame) -> DataFrame:
    """Fixes (route_id, seq, done_m) with the section they are in (start_m, stop_m, name) and the name of the next one.

    Sections of a route do not overlap; if they do, the one that began last counts. Fixes and sections of a route are sorted together
    once and the last section is carried along, so no fix meets all sections.
    """
    following = F.lead("name").over(W.partitionBy("route_id").orderBy("start_m", "stop_m"))
    told = sections.select("route_id", F.col("start_m").cast("double").alias("__at"), F.struct("stop_m", "name", following.alias("next_name")).alias("__told"))
    both = fixes.withColumn("__at", F.col("done_m").cast("double")).withColumn("__fix", F.lit(1)).unionByName(told.withColumn("__fix", F.lit(0)), allowMissingColumns=True)
    order = W.partitionBy("route_id").orderBy("__at", "__fix", "__told.stop_m")
    held = both.withColumn("__held", F.last("__told", True).over(order.rowsBetween(W.unboundedPreceding, 0))).filter("__fix = 1")
    inside = F.col("done_m") < F.col("__held.stop_m")
    return held.select(*fixes.columns, F.when(inside, F.col("__held.name")).alias("name"), F.when(inside, F.col("__held.next_name")).alias("next_name"))


def split_edges(edges: DataFrame, places: DataFrame) -> DataFrame:
    """edge_id, part (0, 1), points: edges (edge_id, points of x and y) cut at a place (edge_id, x, y) on their nearest segment.

    The first of equally near segments is cut; edges without a place stay whole as part 0.
    """
    at = edges.join(places, "edge_id", "left")
    k = F.sequence(F.lit(0), F.size("points") - 2)
    a, b = (lambda i: F.get("points", i)), (lambda i: F.get("points", i + 1))
    near = F.array_min(F.transform(k, lambda i: F.struct(point_segment(F.col("x"), F.col("y"), a(i)["x"], a(i)["y"], b(i)["x"], b(i)["y"])["d"].alias("d"), i.alias("i"))))
    told = at.withColumn("__i", F.when(F.col("x").isNotNull(), near["i"]))
    cut = F.array(F.struct("x", "y"))
    head, tail = F.slice("points", 1, F.col("__i") + 1), F.slice("points", F.col("__i") + 2, F.size("points"))
    parts = F.when(F.col("__i").isNull(), F.array(F.col("points"))).otherwise(F.array(F.concat(head, cut), F.concat(cut, tail)))
    return told.select("edge_id", F.posexplode(parts).alias("part", "points"))
