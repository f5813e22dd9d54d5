"""Boxes of one block share their tiles: a tile goes to them once, and crops and ways stay what they were."""

import numpy as np

from tracegraph.operators import dense, voxels


def test_a_tile_goes_to_a_block_once(spark, monkeypatch):
    r = np.random.default_rng(3)
    image = r.integers(1, 1000, (20, 20, 20))
    v = spark.createDataFrame([(*map(int, p), int(image[tuple(p)])) for p in np.argwhere(image)], "x int, y int, z int, v int")
    rois = [(i, *map(int, r.integers(-6, 20, 3))) for i in range(60)]
    seen = []
    plain = voxels.beside_tiles

    def counted(boxes, tiles, run, returns):
        held = plain(boxes, tiles, lambda own, near: own[["roi"]].assign(n=len(near)), "roi long, n long").collect()
        seen.append((len(held), max(row.n for row in held)))
        return plain(boxes, tiles, run, returns)

    monkeypatch.setattr(dense, "beside_tiles", counted)
    got = dense.crops(spark.createDataFrame(rois, "roi long, x0 long, y0 long, z0 long"), v, 8, [20, 20, 20]).collect()
    whole = np.pad(image, 16)
    want = {i: whole[tuple(slice(16 + c, 24 + c) for c in at)] for i, *at in rois}
    assert len(got) == 60 and all((np.frombuffer(row.crop, "<i4").reshape(8, 8, 8) == want[row.roi]).all() for row in got)
    assert seen == [(60, 8)]  # the 8 tiles of 16 that the image has, for all crops that begin in a block
