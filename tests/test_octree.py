"""Joins of crowded cells against brute force, with places that many nodes share."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tracegraph.operators import grid, octree


def _crowd(seed: int, n: int, comps: int, whole: bool) -> list[tuple]:
    """Nodes around a few middles, most of them in one cell, a tenth at one place."""
    r = np.random.default_rng(seed)
    at = np.concatenate([r.normal(3, 1.5, (n // 2, 3)), r.normal(-4, 9, (n - n // 2 - n // 10, 3)), np.full((n // 10, 3), 5.0)])
    if whole:
        at = np.round(at)
    comp = r.integers(0, comps, n)
    return [(int(i) * 3 + 1, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(at, comp, strict=True))]


def _all_pairs(rows, half):
    x = np.array([r[1:4] for r in rows])
    near = (np.abs(x[:, None] - x[None]) <= half).all(2)
    return x, near & ~np.eye(len(rows), dtype=bool)


COLUMNS = "nid long, x double, y double, z double, comp long"


@pytest.mark.parametrize("whole", [True, False])
def test_box_pairs_of_crowded_cells(spark, whole):
    rows = _crowd(1, 300, 5, whole)
    extra = [(None, 1.0, 1.0, 1.0, 1), (5000, None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows + extra, COLUMNS)
    _, near = _all_pairs(rows, 4)
    want = sorted((rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(near), strict=True))
    got = sorted((r.nid, r.m) for r in grid.box_pairs(df, df, 4, capacity=8).select("nid", "m").collect())
    assert got == want


@pytest.mark.parametrize(("comps", "k"), [(1, 1), (2, 1), (40, 1), (3, 2), (40, 2)])
def test_nearest_in_crowded_cells(spark, comps, k):
    rows = _crowd(comps + k, 300, comps, comps != 40)
    df = spark.createDataFrame([*rows, (7000, 3.0, 3.0, 3.0, None)], COLUMNS)
    x, near = _all_pairs(rows, 4)
    want = []
    for i, r in enumerate(rows):
        found = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 6), rows[j][0]) for j in np.flatnonzero(near[i]) if rows[j][4] != r[4])
        if len(found) >= k:
            want += [(r[0], m, d, n + 1) for n, (d, m) in enumerate(found[:k])]
    got = grid.nearest_foreign(df, df, 4, k, capacity=8).collect()
    assert sorted((r.nid, r["rank"], r.m) for r in got) == sorted((a, n, m) for a, m, _, n in want)
    assert {(r.nid, r["rank"]): round(r.dist, 6) for r in got} == pytest.approx({(a, n): d for a, _, d, n in want}, abs=2e-6)


def test_few_pairs_of_leaves_in_one_crowded_cell(spark):
    """60,000 nodes in one cell: no leaf holds more than the capacity. A leaf of two components knows of a node within its
    own diagonal, so it meets leaves at that distance: (2 sqrt(3) + 1)^3, or 89, if all are of its size."""
    spots = spark.range(60_000).selectExpr("id nid", *(f"pmod(xxhash64(id, {i}), 1000003) / 1000003D * 8 {k}" for i, k in enumerate("xyz")), "id % 5000 comp")
    a = octree.placed(spots, 8.0)
    cells = octree.crowded_cells(a, a, 100)
    assert cells.count() == 1
    rows = octree.with_leaves(a.join(octree.around(cells), octree.CELL), 100).persist()
    sizes = [r["count"] for r in rows.groupBy("leaf").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 100
    t = octree.tree(rows)
    assert octree.leaf_pairs(t, t, 8.0, 1).count() < 89 * len(sizes)
    rows.unpersist()


def test_one_place_of_many_nodes_is_dealt_into_parts(spark):
    spots = spark.range(20_000).selectExpr("id nid", "1D x", "1D y", "1D z", "id comp")
    a = octree.placed(spots, 8.0)
    rows = octree.with_leaves(a.join(octree.around(octree.crowded_cells(a, a, 500)), octree.CELL), 500)
    sizes = [r["count"] for r in rows.groupBy("leaf").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 750
    got = grid.nearest_foreign(spots, spots, 8, 1, capacity=500)
    assert {(r.m, r["count"]) for r in got.groupBy("m").count().collect()} == {(0, 19_999), (1, 1)}


@pytest.mark.parametrize(("k", "capacity"), [(1, 512), (2, 4)])
def test_nearest_in_full_boxes_begins_with_small_ones(spark, monkeypatch, k, capacity):
    """800 nodes in a cube of 16: small boxes do for them; a few nodes far away go on to the whole box."""
    r = np.random.default_rng(k)
    at = np.concatenate([r.integers(0, 16, (800, 3)), [(100, 100, 100), (100, 100, 107), (200, 0, 0)]]).astype(float)
    rows = [(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(at, r.integers(0, 200, len(at)), strict=True))]
    x, near = _all_pairs(rows, 8)
    want = set()
    for i, row in enumerate(rows):
        found = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 6), j) for j in np.flatnonzero(near[i]) if rows[j][4] != row[4])
        want |= {(i, n + 1, j) for n, (_, j) in enumerate(found[:k])} if len(found) >= k else set()
    boxes, pairs = [], grid._pairs
    monkeypatch.setattr(grid, "_pairs", lambda a, b, half, *how: boxes.append(half) or pairs(a, b, half, *how))
    df = spark.createDataFrame(rows, COLUMNS)
    assert {(q.nid, q["rank"], q.m) for q in grid.nearest_foreign(df, df, 8, k, capacity).collect()} == want
    assert boxes[0] < 8 and boxes[-1] == 8


def test_boxes_with_one_child_are_left_out(spark):
    """Nodes at two places: the cell and two leaves, or the parts of what is full, are all there is; before, a box a level."""
    spots = spark.range(40).selectExpr("id nid", "1 + id % 2 * 0.001D x", "1D y", "1D z", "id comp")
    a = octree.placed(spots, 8.0)
    rows = octree.with_leaves(a.join(octree.around(octree.crowded_cells(a, a, 30)), octree.CELL), 30)
    t = octree.tree(rows)
    assert sorted(r.id.l for r in t.select("id").distinct().collect())[0] == 0 and t.select("id").distinct().count() <= 4
    assert octree.leaf_pairs(t, t, 8.0).count() == 4


def test_pairs_of_leaves_are_dealt_out(spark):
    """800 nodes of few bytes and 60,000 pairs: before, Spark put the pairs of leaves together into four tasks or fewer."""
    spots = spark.range(800).selectExpr("id nid", *(f"pmod(xxhash64(id, {i}), 1009) / 1009D * 20 {k}" for i, k in enumerate("xyz")), "cast(null as long) comp")
    a = octree.placed(spots, 8.0)
    pairs = octree.crowded_pairs(a, a, octree.crowded_cells(a, a, 20), 8.0, 20)
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 6
