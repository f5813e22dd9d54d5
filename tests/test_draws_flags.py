"""Keyed permutations and the draws made with them, flags of proofreading, blocks that hold their border."""

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import augment, edits, grid, numbers, paths, review


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000])
def test_permuted_is_a_permutation(spark, n):
    one, two = ([r.x for r in numbers.permuted(spark.range(n).select(F.col("id").alias("x"), "id"), "x", n, seed).orderBy("id").collect()] for seed in (0, 1))
    assert sorted(one) == sorted(two) == list(range(n))
    assert n < 50 or one != two and one != sorted(one)


def test_permuted_of_large_numbers_costs_its_rows_only(spark):
    n = 10**14 + 7
    got = [r.x for r in numbers.permuted(spark.range(2000).select(F.col("id").alias("x")), "x", n).collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) < n // 100 and n - n // 100 < max(got) < n


def test_background_blocks_are_whole_tiles_drawn_once(spark):
    rois = [(1, 0, 5, 2, 9, 8, 7), (2, 1, 1, 1, 3, 8, 8), (3, 4, 0, 0, 40, 4, 12), (4, -8, 0, 0, 4, 4, 4), (5, 0, 0, 0, 100, 100, 3)]
    images = spark.createDataFrame(rois, "roi long, x0 long, y0 long, z0 long, sx long, sy long, sz long")
    every = {tuple(r) for r in grid.tiles(images, 4, whole_only=True).collect()}
    got = augment.background_blocks(images, 4, 10_000, 3).collect()
    assert {tuple(r)[1:] for r in got} == every and sorted(r.number for r in got) == list(range(1, len(every) + 1))
    few = augment.background_blocks(images, 4, 6, 3).collect()
    assert {tuple(r) for r in few} == {tuple(r) for r in got if r.number <= 6}
    assert augment.background_blocks(images.where("roi = 2"), 4, 6).collect() == []
    assert augment.background_blocks(images.limit(0), 4, 6).collect() == []
    one = augment.background_blocks(images.where("roi = 4"), 4, 6).collect()
    assert [tuple(r) for r in one] == [(1, 4, -8, 0, 0, 4, 4, 4)]


def test_proofreading_writes_flags_alone(spark):
    columns = "nid long, comp long, type int, checked int"
    nodes = spark.createDataFrame([(1, 1, 0, 1), (2, 1, 0, 0), (3, 1, 0, 1), (4, 4, 0, 1), (5, 4, 0, 0), (6, None, 0, 1), (7, 7, 0, 1)], columns)
    log = [
        (1, 2, "uncheck"), (2, 1, "check"), (3, 3, "uncheck"), (4, 4, "uncheck"), (5, 2, "delete_node"), (6, 2, "change_type"), (7, 6, "uncheck"), (8, 6, "check"),
        (9, 7, "uncheck"), (10, 7, "check"), (10, 7, "check"), (11, 99, "check"),
    ]
    df = spark.createDataFrame(log, "seq long, nid long, action string")
    got = {r.nid: (r.type, r.checked) for r in edits.proofread(nodes, df).collect()}
    # 3 was unchecked after its component's last check, 4's component was never submitted, 6 has no component
    assert got == {1: (0, 1), 2: (0, -1), 3: (0, 1), 4: (0, 1), 5: (0, 0), 6: (0, 1), 7: (0, -1)}
    assert edits.proofread(nodes, df.limit(0)).count() == 7


def test_purge_takes_nodes_on_the_border(spark):
    nodes = spark.createDataFrame([(1, 50, 50, 50), (2, 0, 0, 0), (3, 130, 130, 130), (4, 131, 50, 50), (5, -1, 50, 50)], "nid long, x long, y long, z long")
    edges = spark.createDataFrame([], "src long, dst long")
    assert sorted(r.nid for r in review.purge(nodes, edges, 1, [10, 10, 10], [100, 100, 100]).collect()) == [2, 3]


def test_chains_by_creator_and_counts(spark):
    """Node 3 is a fork of all edges, but not of those by 'a'."""
    nodes = spark.createDataFrame([(i, i, 2 * i, 0) for i in range(1, 8)], "nid long, x long, y long, z long")
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (3, 4, "a"), (3, 5, "b"), (6, 7, "b"), (5, 6, None)], "src long, dst long, creator string")
    chains = paths.paths_by(nodes, edges, "a")
    assert sorted((r.ord, r.nid) for r in chains.collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert paths.paths_by(nodes, edges, "a", 4).isEmpty() and paths.paths_by(nodes, edges, "c").isEmpty()
    got = {tuple(r) for r in grid.edges_by_creator(edges, nodes, ["a"]).collect()}
    assert got == {("a", 3, 3, 6, 0), ("default", 3, 4, 8, 0)}
    assert paths.chain_counts(spark.createDataFrame([(1,), (1,), (2,)], "sid long"), "sid").first() == (1, 1, 3)
    assert paths.chain_counts(nodes.limit(0), "nid").first() == (0, 0, 0)
