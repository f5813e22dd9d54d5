"""The search of blocks for the nearest nodes of other components."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tracegraph.operators import blocks, grid


@pytest.mark.parametrize(("whole", "k"), [(True, 1), (True, 3), (False, 2)])
def test_blocks_equal_all_pairs(spark, monkeypatch, whole, k):
    """Nodes on both sides of block borders, ties, centres with fewer than k; a few pairs at a time."""
    monkeypatch.setattr(blocks, "PAIRS", 50)
    r = np.random.default_rng(k)
    at = np.concatenate([r.uniform(-40, 40, (250, 3)), r.uniform(30, 36, (150, 3))])
    at, comp = np.round(at) if whole else at, r.integers(0, 9, 400)
    rows = [(int(i) * 7, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(at, comp, strict=True))]
    df = spark.createDataFrame([*rows, (9001, None, 1.0, 1.0, 1), (9002, 33.0, 33.0, 33.0, None)], "nid long, x double, y double, z double, comp long")
    want = set()
    for i in range(400):
        d = np.sqrt(((at - at[i]) ** 2).sum(1)).round(6)
        near = sorted((d[j], rows[j][0]) for j in np.flatnonzero((np.abs(at - at[i]) <= 2).all(1) & (comp != comp[i])))
        want |= {(rows[i][0], m, round(float(x), 6)) for x, m in near[:k]}
    got = blocks.k_nearest(df, df, 2, k).collect()
    assert len(got) == len(want) and {(q.nid, q.m, round(q.dist, 6)) for q in got} == want


def test_pairs_that_are_not_kept_are_not_dealt(spark):
    """Before, a centre was joined with all nodes of its cells: 240 nodes in one box gave 57,360 pairs."""
    n = spark.range(240).selectExpr("id nid", "id % 8 + 0D x", "id div 8 % 6 + 0D y", "id div 48 + 0D z", "id comp")
    assert grid._pairs(n, n, 4.0, 512, 1).count() == 240


def test_pairs_of_cells_are_dealt_out(spark):
    """Before, the few bytes of 600 nodes made all their pairs in four tasks at most, and those of one file in one."""
    n = spark.range(0, 600, 1, 1).selectExpr("id nid", "id % 10 * 3D x", "id div 10 % 10 * 3D y", "id div 100 * 3D z")
    pairs = grid.box_pairs(n, n, 6)
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 6
