from trailmill.sources import pieces


def plan_of(spark, needed, kept, published, most):
    shape = "tile long, version long"
    rows = pieces.planned(spark.createDataFrame(needed, "frame_id long, tile long"), spark.createDataFrame(kept, shape), spark.createDataFrame(published, shape), most)
    return {(r.frame_id, r.tile): r.action for r in rows.collect()}


def test_stale_pieces_go_before_missing_ones(spark):
    needed = [(1, t) for t in range(7)] + [(2, 5), (2, 6)]
    kept, published = [(0, 3), (1, 2), (4, 2), (6, 9)], [(0, 3), (1, 3), (2, 1), (3, 1), (4, 3)]
    found = plan_of(spark, needed, kept, published, 3)
    assert found == {(1, 0): "read", (1, 1): "refresh", (1, 2): "fill", (1, 3): "left", (1, 4): "refresh", (1, 5): "none", (1, 6): "read", (2, 5): "none", (2, 6): "read"}
    offline = plan_of(spark, needed, kept, published, 0)
    assert offline[1, 1] == "old" and offline[1, 2] == "left"
    assert plan_of(spark, [], kept, published, 3) == {}


def test_too_large_frames_have_no_tiles(spark):
    frames = spark.createDataFrame([(1, 0, 0, 1, 1), (2, 0, 0, 2, 1)], "frame_id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted(tuple(r) for r in pieces.frame_tiles(frames, 10, 4).collect()) == [(1, 0), (1, 1), (1, 10), (1, 11)]


def test_only_the_tiles_of_the_plan_are_read(spark, tmp_path):
    edges = spark.range(400).selectExpr("id as edge_id", "id % 40 as tile")
    store, source = f"file://{tmp_path}/kept", f"file://{tmp_path}/published"
    pieces.write_pieces(edges.filter("tile % 2 = 0"), store)
    pieces.write_pieces(edges, source)
    plan_path = f"file://{tmp_path}/plan"
    spark.createDataFrame([(1, 2, "read"), (1, 3, "fill"), (2, 3, "refresh"), (2, 5, "left")], "frame_id long, tile long, action string").write.parquet(plan_path)
    found = pieces.frame_edges(spark, spark.read.parquet(plan_path), store, source)
    assert sorted((r.frame_id, r.edge_id) for r in found.collect()) == sorted([(1, k) for k in range(400) if k % 40 in (2, 3)] + [(2, k) for k in range(400) if k % 40 == 3])
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
