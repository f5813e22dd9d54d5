"""Tables sorted by cells, dense tiles with halos, crops, and regions joined at the faces of cubes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.functions.geometry import AXES
from tracegraph.operators import components, dense, repair, voxels
from tracegraph.sources import layout


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def volume(spark, image, seed=1, share=0.9, most=500):
    r = random.Random(seed)
    v = {p: r.randrange(1, most) for p in np.ndindex(*image) if r.random() < share}
    return v, spark.createDataFrame([(*map(int, p), x) for p, x in v.items()], "x int, y int, z int, v int")


# layout


def test_morton_numbers(spark):
    r = random.Random(2)
    at = [tuple(r.randrange(1 << r.choice([2, 9, 21])) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(at, "x long, y long, z long")
    assert rows(df.select(*AXES, layout.morton(F.col("x"), F.col("y"), F.col("z")).alias("m")), *AXES, "m") == sorted((*p, layout.morton_number(*p)) for p in at)


def test_intervals_hold_the_box_and_little_else():
    r = random.Random(3)
    half = 1 << (layout.BITS - 1)
    for _ in range(200):
        low = [r.randrange(-40, 40) for _ in range(3)]
        high = [a + r.randrange(0, 30) for a in low]
        side, most = r.choice([1, 4, 7]), r.choice([1, 8, 64])
        found = layout.intervals(low, high, side, most)
        assert len(found) <= most and all(a <= b for a, b in found) and all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
        cells = {tuple(v // side + half for v in p) for p in np.ndindex(*(h - a for a, h in zip(low, high, strict=True))) for p in [[a + q for a, q in zip(low, p, strict=True)]]}
        assert all(any(a <= layout.morton_number(*c) <= b for a, b in found) for c in cells)
        if not cells:
            assert not found or any(a < b for a, b in zip(low, high, strict=True))
    wide = sum(b - a + 1 for a, b in layout.intervals([0, 0, 0], [64, 64, 64], 1))
    assert wide == 64**3


def test_a_box_reads_only_the_pages_that_touch_it(spark, tmp_path):
    path = str(tmp_path / "cells")
    n = 1 << 18
    df = spark.range(n).select("id", *(F.shiftright("id", s).bitwiseAND(F.lit(63)).cast("int").alias(k) for k, s in zip(AXES, (12, 6, 0), strict=True)))
    layout.write_cells(df.withColumn("x", F.col("x") - 20), path, 8)
    for low, high in (([-12, 8, 16], [-4, 16, 24]), ([0, 0, 0], [10, 10, 10]), ([-20, 0, 0], [44, 64, 64]), ([300, 0, 0], [400, 9, 9]), ([5, 5, 5], [5, 9, 9])):
        got = layout.read_box(spark, path, low, high)
        want = max(0, min(high[0], 44) - max(low[0], -20)) * (high[1] - low[1]) * (high[2] - low[2])
        assert got.columns == ["id", "x", "y", "z"] and len(got.collect()) == want
        scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
        if scan.metrics().contains("numOutputRows"):
            touched = scan.metrics().apply("numOutputRows").value()
            assert touched <= max(4 * layout.PAGE_ROWS, 8 * want) and (want < n or touched == n)
    with pytest.raises(Exception, match="out of the grid"):
        df.select(F.lit(1 << 30).alias("x"), "y", "z").select(layout.cell(8)).collect()


# dense tiles


def mean_filter():
    def box_mean(block):
        """The mean of the 3 x 3 x 3 voxels around each, the block's border mirrored."""
        p = np.pad(block.astype(float), 1, mode="reflect")
        n = block.shape
        return sum(p[a : a + n[0], b : b + n[1], c : c + n[2]] for a in range(3) for b in range(3) for c in range(3)) / 27

    return box_mean


@pytest.mark.parametrize("image", [(20, 17, 9), (8, 8, 8), (33, 5, 1)])
def test_tiles_with_halos_equal_the_untiled_image(spark, image):
    v, df = volume(spark, image)
    whole = np.zeros(image, np.int32)
    for p, x in v.items():
        whole[p] = x
    box_mean = mean_filter()

    def scorer(block):
        assert block.shape == (14, 14, 14) and block.dtype == np.int32
        return box_mean(block)

    # one reflection less than the halo is deep: the image's border is mirrored in both
    want = box_mean(whole) if min(image) > 1 else None
    got = {r[:3]: r for r in map(tuple, dense.score_dense(df, list(image), 8, 3, scorer).collect())}
    assert got.keys() == v.keys() and all(got[p][3] == x for p, x in v.items())
    if want is not None:
        assert all(abs(got[p][4] - want[p]) < 1e-9 for p in v)


def test_blocks_of_short_tiles_are_mirrored_as_padding_does(spark):
    """The blocks themselves, against padding of the cut-out of the image."""
    image, size, halo = [11, 9, 5], 4, 2
    v, df = volume(spark, image, 5, 0.6)
    whole = np.zeros(image, np.int32)
    for p, x in v.items():
        whole[p] = x
    parts = dense.exchanged(df, image, size, halo).toPandas()
    seen = 0
    for at, group in parts.groupby(["tx", "ty", "tz"]):
        found = dense.assembled(group, image, size, halo)
        lo, hi = [max(0, t * size - halo) for t in at], [min(n, (t + 1) * size + halo) for n, t in zip(image, at, strict=True)]
        cut = whole[tuple(slice(a, b) for a, b in zip(lo, hi, strict=True))]
        pads = [(halo - (t * size - a), 0) for t, a in zip(at, lo, strict=True)]
        pads = [(p, size + 2 * halo - p - n) for (p, _), n in zip(pads, cut.shape, strict=True)]
        if found is not None:
            seen += 1
            assert (found[0] == np.pad(cut, pads, mode="reflect")).all()
    assert seen == 3 * 3 * 2


def test_dense_default_and_pre_filter(spark):
    image = [10, 10, 10]
    v, df = volume(spark, image, 7, 0.5)
    got = dense.score_dense(df, image, 10, 0, before=dense.clipped(0.99))
    values = sorted([0] * (1000 - len(v)) + list(v.values()))
    top = values[int(1000 * 0.99) - 1]
    assert all(abs(r.norm - min(r.v, top) / top) < 1e-9 for r in got.collect())
    flat = spark.createDataFrame([(x, 0, 0, 9) for x in range(4)], "x int, y int, z int, v int")
    assert {r.norm for r in dense.score_dense(flat, [4, 1, 1], 4, 0).collect()} == {0.0}
    assert dense.score_dense(flat.limit(0), [4, 1, 1], 4, 0).count() == 0


# crops


@pytest.mark.parametrize("padding", ["constant", "reflect"])
def test_crops(spark, padding):
    image = [9, 20, 5]
    v, df = volume(spark, image, 9)
    corners = {1: (0, 0, 0), 2: (-4, 15, 1), 3: (7, -3, -2), 4: (100, 0, 0), 5: (-40, -40, -40)}
    rois = spark.createDataFrame([(k, *p) for k, p in corners.items()], "roi long, x0 long, y0 long, z0 long")

    def at(p):
        q = []
        for c, n in zip(p, image, strict=True):
            if padding == "reflect":
                c %= 2 * n - 2
                c = c if c < n else 2 * n - 2 - c
            q.append(c)
        return v.get(tuple(q), 0)

    got = {r.roi: np.frombuffer(r.crop, "<i4").reshape(6, 6, 6) for r in dense.crops(rois, df, 6, image, padding).collect()}
    for k, corner in corners.items():
        assert all(got[k][p] == at([a + b for a, b in zip(corner, p, strict=True)]) for p in np.ndindex(6, 6, 6))


def test_a_model_that_reads_the_crop(spark):
    n = spark.createDataFrame([(i, 20.5 + i, 20.0, 20.0) for i in range(8)], "nid long, x double, y double, z double")
    e = spark.createDataFrame([(i, i + 1) for i in range(7)], "src long, dst long")
    v = spark.createDataFrame([(30, 21, 20, 50), (10, 19, 20, 40), (60, 20, 20, 99)], "x int, y int, z int, v int")

    def brightest(track):
        assert len(track) == 1 and track["crop"].iloc[0].shape == (32, 32, 32) and track.attrs["points"] == 5
        return np.array([np.unravel_index(int(track["crop"].iloc[0].argmax()), (32, 32, 32))]) - 16.0

    got = repair.next_points(n, e, model=brightest, voxels=v, image=[64, 64, 64])
    assert rows(got, "nid", "x", "y", "z") == [(0, 30.5, 21.0, 20.0), (7, 30.5, 21.0, 20.0)]
    plain = repair.next_points(n, e)
    assert rows(repair.next_points(n, e, voxels=v, image=[64, 64, 64]), "nid", *AXES) == rows(plain, "nid", *AXES)


# regions


def test_regions_of_cubes_equal_a_search(spark, monkeypatch):
    v, df = volume(spark, (14, 13, 12), 11, 0.12)
    left, want = set(v), {}
    while left:
        open_ = [min(left)]
        found = set(open_)
        left -= found
        while open_:
            p = open_.pop()
            near = {tuple(a + b for a, b in zip(p, o, strict=True)) for o in np.ndindex(3, 3, 3) for o in [[k - 1 for k in o]]} & left
            left -= near
            found |= near
            open_ += near
        least = min((x * voxels.BASE + y) * voxels.BASE + z for x, y, z in found)
        want |= dict.fromkeys(found, least)
    sent = []
    real = voxels.star_edges
    monkeypatch.setattr(voxels, "star_edges", lambda links: sent.append(links.count()) or real(links))
    for side in (4, 5, 32):
        got = voxels.regions(df.withColumn("region", F.lit(None).cast("long")).drop("region").union(df.limit(3)), side)
        assert {(r.x, r.y, r.z): r.region for r in got.collect()} == want and got.count() == len(v) + 3
    assert sent[-1] == 0 and sent[0] < len(v)
    assert components.hook is voxels.hook
