"""Planning frames over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..scratch import saved, scratch_root
from ..sources import pieces as P
from .catalog import query, table

# Orders are edges on a grid of 16 by 16 tiles; older ones are kept, and a third of the tiles not at all.
FRAMES = """o AS (SELECT o_orderkey AS edge_id, (o_orderkey // 7 % 16) * 20 + o_custkey % 16 AS tile, o_custkey AS cost FROM orders),
pb AS (SELECT tile, max(edge_id) AS version FROM o WHERE tile % 11 <> 10 GROUP BY 1), kp AS (SELECT tile, max(edge_id) AS version FROM o WHERE edge_id % 5 <> 0 AND tile % 3 <> 0 GROUP BY 1),
f AS (SELECT s_suppkey AS frame_id, s_suppkey % 14 AS x0, s_nationkey % 13 AS y0, s_suppkey % 14 + s_suppkey % 4 AS x1, s_nationkey % 13 + s_nationkey % 4 AS y1 FROM supplier),
c AS (SELECT frame_id, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM f WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= 12), n AS (SELECT frame_id, y * 20 + x AS tile FROM (SELECT frame_id, x, unnest(range(y0, y1 + 1)) AS y FROM c)),
m AS (SELECT frame_id, tile, kp.version AS k, coalesce(kp.version < pb.version, FALSE) AS stale, kp.version IS NULL AND pb.version IS NOT NULL AS missing FROM n LEFT JOIN kp USING (tile) LEFT JOIN pb USING (tile)),
w AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY stale DESC, missing DESC, tile) <= 4 AS online FROM m),
plan AS (SELECT frame_id, tile, CASE WHEN stale THEN CASE WHEN online THEN 'refresh' ELSE 'old' END WHEN missing THEN CASE WHEN online THEN 'fill' ELSE 'left' END WHEN k IS NULL THEN 'none' ELSE 'read' END AS action FROM w)"""


def graph_edges(spark, sf_dir):
    """Published edges and those kept, with their tiles."""
    o = table(spark, sf_dir, "orders")
    tile = (F.floor(F.col("o_orderkey") / 7) % 16) * 20 + F.col("o_custkey") % 16
    edges = o.select(F.col("o_orderkey").alias("edge_id"), tile.cast("long").alias("tile"), F.col("o_custkey").alias("cost"))
    return edges.filter("tile % 11 <> 10"), edges.filter("edge_id % 5 <> 0 and tile % 3 <> 0")


def frame_plan(spark, sf_dir):
    """What each supplier's frame reads, refreshes and fills."""
    k, n = F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long")
    frames = table(spark, sf_dir, "supplier").select(k.alias("frame_id"), (k % 14).alias("x0"), (n % 13).alias("y0"), (k % 14 + k % 4).alias("x1"), (n % 13 + n % 4).alias("y1"))
    published, kept = graph_edges(spark, sf_dir)
    return P.planned(P.frame_tiles(frames, 20, 12), P.versions(kept, "edge_id"), P.versions(published, "edge_id"), 4)


@query(f"WITH {FRAMES} SELECT frame_id::BIGINT AS frame_id, tile::BIGINT AS tile, action FROM plan")
def r17_frame_plan(spark, sf_dir):
    """Which pieces of a frame are read, refreshed, filled or left."""
    return frame_plan(spark, sf_dir)


@query(
    f"""WITH {FRAMES}, e AS (SELECT frame_id, o.* FROM plan JOIN o USING (tile) WHERE action IN ('read', 'old') AND edge_id % 5 <> 0 UNION ALL SELECT frame_id, o.* FROM plan JOIN o USING (tile) WHERE action IN ('refresh', 'fill'))
SELECT frame_id::BIGINT AS frame_id, count(*) AS edges, count(DISTINCT tile) AS tiles, sum(cost)::BIGINT AS cost FROM e GROUP BY 1"""
)
def r17_frame_graphs(spark, sf_dir):
    """The graph of each frame, read from stores of pieces by tile."""
    store, source = (f"{scratch_root(spark)}/pieces-{name}-{uuid.uuid4().hex}" for name in ("kept", "published"))
    published, kept = graph_edges(spark, sf_dir)
    P.write_pieces(kept, store)
    P.write_pieces(published, source)
    found = P.frame_edges(spark, saved(frame_plan(spark, sf_dir), "frames"), store, source)
    return found.groupBy("frame_id").agg(F.count("*").alias("edges"), F.count_distinct("tile").alias("tiles"), F.sum("cost").alias("cost"))
