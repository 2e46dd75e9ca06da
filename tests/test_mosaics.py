import random

from trailmill.operators import mosaics


def test_seams_are_those_of_one_raster(spark):
    rng, side, wide, high = random.Random(5), 4, 5, 3
    whole = {(gx, gy): rng.choice([None, *range(20)]) for gx in range(wide * side + 1) for gy in range(high * side + 1)}
    kept = [(x, y) for x in range(wide) for y in range(high) if (x, y) not in {(2, 1), (4, 2)}]
    rows = [(x, y, [whole[x * side + c, y * side + r] for r in range(side + 1) for c in range(side + 1)]) for x, y in kept]
    blocks = mosaics.mosaic(spark.createDataFrame(rows, "x int, y int, heights array<int>"), side)
    known = {(x * side + c, y * side + r) for x, y in kept for r in range(side + 1) for c in range(side + 1)}
    expected = {p: whole[p] for p in known if whole[p] is not None}
    assert {(r.gx, r.gy): r.block for r in mosaics.samples(blocks, side).collect()} == expected
    around = lambda gx, gy: [expected[q] for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (q := (gx + dx, gy + dy)) in expected]
    for r in mosaics.samples(mosaics.smoothed(blocks, side), side).collect():
        near = around(r.gx, r.gy)
        assert r.block == expected[r.gx, r.gy] and abs(r.smooth - sum(near) / len(near)) < 1e-9
    thin = {(r.gx, r.gy): r.block for r in mosaics.samples(blocks, side, 3).collect()}
    assert thin == {p: v for p, v in expected.items() if p[0] % 3 == 0 and p[1] % 3 == 0}


def test_unlike_borders_and_nothing(spark):
    # the tile of its own comes first, then the northern, the western, the north-western neighbour
    flat = lambda v: [v] * 9
    tiles = [(0, 0, flat(1)), (1, 0, flat(2)), (0, 1, flat(3))]
    blocks = mosaics.mosaic(spark.createDataFrame(tiles, "x int, y int, heights array<int>"), 2)
    found = {(r.gx, r.gy): r.block for r in mosaics.samples(blocks, 2).collect()}
    assert found[2, 2] == 2 and found[0, 2] == 3 and found[3, 2] == 2 and found[2, 3] == 3 and found[2, 0] == 2 and (3, 3) not in found
    assert mosaics.mosaic(spark.createDataFrame([], "x int, y int, heights array<int>"), 2).count() == 0
