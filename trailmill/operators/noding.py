"""A planar road graph: lines cut where they share vertices, cross or are tied, and trails and connectors laid on it.

Lines are (line_id, level, points of x and y in metres). A node is a place on a grid of millimetres; a crossing is computed once for both
lines, so nodes agree whatever cells, tasks or lines they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import legs, line_length, point_segment
from ..scratch import saved
from .corridors import nearest_lines
from .matching import CORRIDOR_M, SAME, STEP_M, in_micrometres, near_points, samples_of, segments_of
from .overlays import ANCHOR_M, SNAP_M, shares_of

# Fixed values in metres: reach of a dead end, least way between junctions of a connector, what is no gap; how near the ends of a segment is no crossing.
DEAD_END_M, SPACING_M, GAP_FREE_M, END_SHARE = 2.0, 15.0, 5.0, 1e-3


def node_of(x: Column, y: Column) -> Column:
    """The node of a place: its millimetres as text."""
    mm = lambda v: F.floor(v * 1000 + 0.5).cast("string")
    return F.concat_ws(",", mm(x), mm(y))


def cut_lines(lines: DataFrame, cuts: DataFrame | None = None, shared: bool = True) -> DataFrame:
    """line_id, part, a, b, points, length and the other columns of lines: the pieces between cuts, numbered from 0, with their end nodes.

    Lines are cut at ``cuts`` (line_id, at, x, y; ``at`` is the number of the segment and the share of it) and, if ``shared``, at vertices
    that occur more than once in all lines. Neighbours on one node are one vertex; lines without two nodes have no pieces.
    """
    rest = [c for c in lines.columns if c not in ("line_id", "points")]
    vertices = lines.select("line_id", F.posexplode("points").alias("pos", "p")).select("line_id", F.col("pos").cast("double").alias("at"), "p.x", "p.y", F.lit(False).alias("cut"))
    vertices = vertices.withColumn("node", node_of(F.col("x"), F.col("y")))
    if shared:
        often = vertices.groupBy("node").agg(F.count("*").alias("__n")).filter("__n > 1").select("node", F.lit(True).alias("__often"))
        vertices = vertices.join(often, "node", "left").withColumn("cut", F.col("__often").isNotNull()).drop("__often")
    if cuts is not None:
        vertices = vertices.unionByName(cuts.select("line_id", "at", "x", "y", F.lit(True).alias("cut"), node_of(F.col("x"), F.col("y")).alias("node")))
    # one shuffle by line: runs of one node become one vertex, then parts are numbered by a running sum of cuts
    order = W.partitionBy("line_id").orderBy("at", "node")
    new = (~F.col("node").eqNullSafe(F.lag("node").over(order))).cast("int")
    runs = vertices.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    one = runs.groupBy("line_id", "__run").agg(F.max("cut").alias("cut"), F.min_by(F.struct("x", "y"), "at").alias("p"), F.first("node").alias("node"))
    line = W.partitionBy("line_id")
    by_run = line.orderBy("__run")
    ends = one.withColumns({"__last": F.max("__run").over(line)}).filter("__last > 1")
    inner = F.col("cut") & (F.col("__run") > 1) & (F.col("__run") < F.col("__last"))
    numbered = ends.withColumn("__inner", inner).withColumn("part", F.coalesce(F.sum(F.col("__inner").cast("int")).over(by_run.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    both = numbered.withColumn("part", F.explode(F.when(F.col("__inner"), F.array(F.col("part") - 1, F.col("part"))).otherwise(F.array("part"))))
    rows = F.sort_array(F.collect_list(F.struct("__run", "p", "node")))
    pieces = both.groupBy("line_id", "part").agg(rows.alias("r"))
    told = pieces.select("line_id", F.col("part").cast("int").alias("part"), F.get("r", F.lit(0))["node"].alias("a"), F.element_at("r", -1)["node"].alias("b"), F.transform("r", lambda v: v["p"]).alias("points"))
    told = told.withColumn("length", line_length(F.col("points")))
    return told.join(lines.select("line_id", *rest), "line_id") if rest else told


def crossing_cuts(lines: DataFrame, cell: float = 50.0, block: int = 512) -> DataFrame:
    """line_id, at, x, y: where segments of different lines of one level cross inside both, once for each of both lines.

    Segments go to the cells that their box touches; a pair meets in the first cell that both have, so nothing is made unique afterwards.
    Cells of more than ``block`` segments are dealt to blocks, and each two blocks meet apart.
    """
    low, high = lambda a, b: F.floor(F.least(a, b) / cell), lambda a, b: F.floor(F.greatest(a, b) / cell)
    s = segments_of(lines).join(lines.select("line_id", "level"), "line_id")
    s = s.select("line_id", "seg", "level", "ax", "ay", "bx", "by", low(F.col("ax"), F.col("bx")).alias("lx"), low(F.col("ay"), F.col("by")).alias("ly"), high(F.col("ax"), F.col("bx")).alias("hx"), high(F.col("ay"), F.col("by")).alias("hy"))
    dealt = s.withColumn("cx", F.explode(F.sequence("lx", "hx"))).withColumn("cy", F.explode(F.sequence("ly", "hy")))
    keys = ["cx", "cy", "level"]
    full = dealt.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks")).filter("__blocks > 1")
    sized = dealt.join(full, keys, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    own, every = F.pmod(F.xxhash64("line_id", "seg"), "__blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    held = F.struct("line_id", "seg", "ax", "ay", "bx", "by", "lx", "ly")
    met = sized.select(*keys, held.alias("p"), own.alias("i"), every.alias("j")).join(sized.select(*keys, held.alias("q"), own.alias("j"), every.alias("i")), [*keys, "i", "j"])
    met = met.filter((F.col("p.line_id") < F.col("q.line_id")) & (F.col("cx") == F.greatest("p.lx", "q.lx")) & (F.col("cy") == F.greatest("p.ly", "q.ly")))
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    rx, ry, sx, sy, dx, dy = p("bx") - p("ax"), p("by") - p("ay"), q("bx") - q("ax"), q("by") - q("ay"), q("ax") - p("ax"), q("ay") - p("ay")
    slope = rx * sy - ry * sx
    inside = lambda v: (v > END_SHARE) & (v < 1 - END_SHARE)
    hit = met.filter(F.abs(slope) >= 1e-9).withColumns({"t": (dx * sy - dy * sx) / slope, "u": (dx * ry - dy * rx) / slope}).filter(inside(F.col("t")) & inside(F.col("u")))
    x, y = p("ax") + F.col("t") * rx, p("ay") + F.col("t") * ry
    two = F.array(F.struct(p("line_id").alias("line_id"), (p("seg") + F.col("t")).alias("at"), x.alias("x"), y.alias("y")), F.struct(q("line_id").alias("line_id"), (q("seg") + F.col("u")).alias("at"), x.alias("x"), y.alias("y")))
    return hit.select(F.inline(two))


def places_along(lines: DataFrame, metres: DataFrame) -> DataFrame:
    """The columns of metres (line_id, m) with at, x, y: the place so far along its line; beyond the ends, the ends."""
    told = metres.join(lines.select("line_id", F.col("points").alias("__points")), "line_id").withColumn("__legs", legs(F.col("__points")))
    at = F.least(F.size(F.filter("__legs", lambda g: g["start"] + g["d"] < F.col("m"))), F.size("__legs") - 1)
    told = told.withColumn("__i", at).withColumn("__g", F.get("__legs", F.col("__i")))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("m") - F.col("__g.start")) / F.nullif(F.col("__g.d"), F.lit(0.0)))), F.lit(0.0))
    told = told.withColumn("__t", t)
    on = lambda a, b: F.col(f"__g.{a}") + F.col("__t") * (F.col(f"__g.{b}") - F.col(f"__g.{a}"))
    return told.select(*metres.columns, (F.col("__i") + F.col("__t")).alias("at"), on("ax", "bx").alias("x"), on("ay", "by").alias("y"))


def dead_end_ties(pieces: DataFrame, reach: float = DEAD_END_M) -> tuple[DataFrame, DataFrame]:
    """(ties, cuts) for pieces (line_id, level, a, b, points): lines (line_id, end, level, points) from each dead end to the nearest other
    node within reach, or else to its foot on the nearest other piece, which is cut there (line_id, at, x, y).

    All dead ends are tied at once; two that are each other's nearest get one tie.
    """
    from .spatial import nearest, within

    end = lambda k, node, p: F.struct(F.lit(k).alias("end"), F.col(node).alias("node"), p["x"].alias("x"), p["y"].alias("y"))
    ends = pieces.select("line_id", "level", F.inline(F.array(end(0, "a", F.get("points", F.lit(0))), end(1, "b", F.element_at("points", -1)))))
    nodes = ends.groupBy("node").agg(F.count("*").alias("degree"), F.min(F.struct("x", "y")).alias("p")).select("node", "degree", "p.x", "p.y")
    dead = saved(ends.join(nodes.filter("degree = 1").select("node"), "node", "left_semi"), "dead-ends")
    others = nodes.select(F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = nearest(within(dead, others, reach).filter("node <> other"), ["node"], "d", ["other"])
    to_node = saved(near.select("node", "other", "line_id", "end", "level", "x", "y", "ox", "oy"), "ties")
    mutual = to_node.select(F.col("node").alias("other"), F.col("other").alias("node")).filter("other < node")
    one = to_node.join(mutual, ["node", "other"], "left_anti")
    line = lambda x, y: F.array(F.struct("x", "y"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    lone = dead.join(to_node.select("node"), "node", "left_anti").select("line_id", F.col("end").alias("pos"), "level", "x", "y")
    met = near_points(lone.select("line_id", "pos", "x", "y"), pieces.select("line_id", "points"), reach)
    best = nearest(met, ["line_id", "pos"], "d", ["other_id"]).join(pieces.select(F.col("line_id").alias("other_id"), "length"), "other_id")
    feet = saved(places_along(pieces, best.select(F.col("other_id").alias("line_id"), F.col("line_id").alias("own"), "pos", (F.col("f") * F.col("length")).alias("m"))), "ties")
    to_foot = lone.join(feet.select(F.col("own").alias("line_id"), "pos", F.col("x").alias("ox"), F.col("y").alias("oy")), ["line_id", "pos"])
    ties = one.select("line_id", "end", "level", line("ox", "oy").alias("points")).unionByName(to_foot.select("line_id", F.col("pos").alias("end"), "level", line("ox", "oy").alias("points")))
    return ties, feet.select("line_id", "at", "x", "y")


def noded(lines: DataFrame, reach: float = DEAD_END_M, cell: float = 50.0, block: int = 512) -> DataFrame:
    """line_id, part, kind (road or tie), level, a, b, points, length: the planar graph of lines (line_id, level, points).

    Lines are cut at shared vertices; then dead ends within reach of another node or piece are tied to it (0: none); then pieces and ties of
    one level are cut where they cross. ``part`` numbers the pieces of a line; a tie counts from 0 at its line's first end, from 1,000,000 at its last.
    """
    first = saved(cut_lines(lines.select("line_id", "level", "points")), "noded")
    whole = first.withColumn("line_id", F.struct("line_id", "part"))
    if reach > 0:
        ties, feet = dead_end_ties(whole, reach)
        as_line = ties.select(F.struct(F.col("line_id.line_id").alias("line_id"), (-1 - F.col("end")).cast("int").alias("part")).alias("line_id"), "level", "points")
        all_lines = saved(whole.select("line_id", "level", "points").unionByName(as_line), "noded")
        cuts = crossing_cuts(all_lines, cell, block).unionByName(feet)
    else:
        all_lines = whole.select("line_id", "level", "points")
        cuts = crossing_cuts(all_lines, cell, block)
    second = cut_lines(all_lines, cuts, shared=False)
    kind = F.when(F.col("line_id.part") < 0, "tie").otherwise("road")
    place = F.row_number().over(W.partitionBy("line_id.line_id", F.least("line_id.part", F.lit(0))).orderBy("line_id.part", "part")) - 1
    number = place + F.when(F.col("line_id.part") == -2, 1_000_000).otherwise(0)
    return second.withColumns({"kind": kind, "__no": number}).select("line_id.line_id", F.col("__no").alias("part"), "kind", "level", "a", "b", "points", "length")


def overlaid(edges: DataFrame, trails: DataFrame) -> DataFrame:
    """line_id, trail_id, share, connector, blocked of edges (line_id, points) that lie on trails (line_id, points, role, two_way).

    An edge lies on the trail that covers it best, by at least 0.8 (of equals the smaller id). ``role`` is downhill, uphill or connector; trails that are neither
    connectors nor ridden both ways block the edge against their direction: ``backward``, or ``forward`` where the edge runs the other way;
    null where it lies across them.
    """
    shares = shares_of(edges, trails, CORRIDOR_M, STEP_M).filter(F.col("share") >= SAME)
    best = shares.groupBy("line_id").agg(F.max(F.struct("share")).alias("m"), F.min_by("other_id", F.struct(-F.col("share"), F.col("other_id"))).alias("trail_id")).select("line_id", "trail_id", "m.share")
    told = best.join(trails.select(F.col("line_id").alias("trail_id"), "role", "two_way"), "trail_id")
    ends = told.filter("role <> 'connector' and not two_way").join(edges.select("line_id", F.get("points", F.lit(0)).alias("p"), F.element_at("points", -1).alias("q")), "line_id")
    met = ends.select("line_id", "trail_id", "p", "q").join(segments_of(trails).withColumnRenamed("line_id", "trail_id"), "trail_id")
    foot = lambda e: point_segment(F.col(e)["x"], F.col(e)["y"], F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = met.withColumns({"fp": foot("p"), "fq": foot("q")})
    nearest = lambda f: F.min(F.struct(F.col(f)["d"].alias("d"), (F.col("start") + F.col(f)["t"] * F.col("own")).alias("m")))
    way = met.groupBy("line_id").agg((nearest("fq")["m"] - nearest("fp")["m"]).alias("way"))
    blocked = F.when(F.abs("way") < STEP_M, F.lit(None)).when(F.col("way") > 0, "backward").when(F.col("way") < 0, "forward")
    return told.join(way, "line_id", "left").select("line_id", "trail_id", "share", (F.col("role") != "downhill").alias("connector"), blocked.alias("blocked"))


def junctions(edges: DataFrame, connectors: DataFrame) -> DataFrame:
    """line_id, pos, m, d, other_id, f: where connectors (line_id, points) are joined to edges on their way.

    Sample by sample the nearest edge within 15 m is looked up; wanted are samples where the corridor begins or ends, where the nearest edge changes and
    where an edge is nearest without a gap. They keep 30 m from both ends and 15 m from one another; of two too near, the one with the
    smaller gap stays, in the order of the line. Gaps count in micrometres, so that the noise of sums decides nothing; of equal gaps the smaller edge counts.
    """
    length = connectors.select("line_id", line_length(F.col("points")).alias("total"))
    hits = nearest_lines(samples_of(connectors, STEP_M), edges, CORRIDOR_M).select("line_id", "pos", F.when(F.col("d").isNotNull(), F.struct("d", "other_id", "f")).alias("h"))
    order = W.partitionBy("line_id").orderBy("pos")
    rows = hits.withColumns({"__b": F.lag("h").over(order), "__a": F.lead("h").over(order), "__n": F.count("*").over(W.partitionBy("line_id"))})
    here, before, after = F.col("h").isNotNull(), F.col("__b"), F.col("__a")
    inner = (F.col("pos") >= 1) & (F.col("pos") <= F.col("__n") - 2)
    closest = (F.col("h.d") <= GAP_FREE_M) & (before.isNull() | (F.col("h.d") <= before["d"])) & (after.isNull() | (F.col("h.d") <= after["d"]))
    comes = inner & (before.isNull() | (before["other_id"] != F.col("h.other_id")) | closest)
    leaves = (F.col("pos") <= F.col("__n") - 3) & after.isNull()
    wanted = rows.filter(here & (comes | leaves)).join(length, "line_id").withColumn("m", F.least(F.col("pos") * STEP_M, F.col("total")))
    wanted = wanted.filter((F.col("m") >= ANCHOR_M) & (F.col("total") - F.col("m") >= ANCHOR_M))
    listed = wanted.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("pos", "m", "h.d", "h.other_id", "h.f"))).alias("w"))

    def step(kept: Column, w: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (w["m"] - last["m"] >= SPACING_M), F.concat(kept, F.array(w))).when(w["d"] < last["d"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(w))).otherwise(kept)

    return listed.select("line_id", F.inline(F.aggregate("w", F.slice("w", 1, 0), step)))


def with_connectors(edges: DataFrame, connectors: DataFrame, k: int = 4) -> DataFrame:
    """line_id, part, kind (road, connector or link), a, b, points, length: edges (line_id, points) with connectors laid on them as lines of their own.

    A connector is cut at its junctions. From each junction a link leads to the foot on its edge, from both ends links lead to up to ``k`` edges within
    30 m, or else to the nearest within 200 m; edges are cut at the feet. A foot on the very node needs no link. Links are numbered along their connector.
    """
    edges, connectors = edges.select("line_id", "points"), connectors.select("line_id", "points")
    on_way = saved(junctions(edges, connectors), "junctions")
    ends = connectors.select("line_id", F.inline(F.array(F.struct(F.lit(-1).alias("pos"), F.get("points", F.lit(0)).alias("p")), F.struct(F.lit(-2).alias("pos"), F.element_at("points", -1).alias("p"))))).select("line_id", "pos", "p.x", "p.y")
    far = near_points(ends, edges, SNAP_M, F.lit(True))
    by = W.partitionBy("line_id", "pos")
    placed = far.withColumns({"__place": F.row_number().over(by.orderBy(in_micrometres("d"), "other_id")), "__best": F.min("d").over(by)})
    anchored = placed.filter((F.col("__place") <= k) & ((F.col("d") <= ANCHOR_M) | ((F.col("__best") > ANCHOR_M) & (F.col("__place") == 1))))
    cuts = saved(places_along(connectors, on_way.select("line_id", "pos", "m")), "junctions")
    starts = cuts.select("line_id", "pos", "x", "y").unionByName(ends)
    wanted = on_way.select("line_id", "pos", "other_id", "f").unionByName(anchored.select("line_id", "pos", "other_id", "f"))
    long = edges.select(F.col("line_id").alias("other_id"), line_length(F.col("points")).alias("__long"))
    metres = wanted.join(long, "other_id").select(F.col("other_id").alias("line_id"), F.col("line_id").alias("own"), "pos", (F.col("f") * F.col("__long")).alias("m"))
    feet = saved(places_along(edges, metres), "junctions")
    links = feet.select(F.col("own").alias("line_id"), "pos", F.col("x").alias("fx"), F.col("y").alias("fy")).join(starts, ["line_id", "pos"])
    links = links.withColumns({"a": node_of(F.col("x"), F.col("y")), "b": node_of(F.col("fx"), F.col("fy"))}).filter("a <> b").dropDuplicates(["line_id", "a", "b"])
    links = links.withColumn("points", F.array(F.struct("x", "y"), F.struct(F.col("fx").alias("x"), F.col("fy").alias("y")))).withColumn("part", F.row_number().over(W.partitionBy("line_id").orderBy("pos", "b")) - 1)
    columns = ["line_id", "part", "kind", "a", "b", "points", "length"]
    roads = cut_lines(edges, feet.select("line_id", "at", "x", "y"), shared=False).withColumn("kind", F.lit("road"))
    own = cut_lines(connectors, cuts.select("line_id", "at", "x", "y"), shared=False).withColumn("kind", F.lit("connector"))
    tied = links.withColumns({"kind": F.lit("link"), "length": line_length(F.col("points"))})
    return roads.select(columns).unionByName(own.select(columns)).unionByName(tied.select(columns))
