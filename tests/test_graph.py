"""Hand-made graphs, and the plans of the range joins."""

import random

import pytest

from tracegraph.operators import augment, edits, graph, grid, paths, repair, review, voxels
from tracegraph.operators.components import _with_least
from tracegraph.sources import tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def G(spark, edges, nodes=()):
    ids = sorted({x for e in edges for x in e} | set(nodes))
    return spark.createDataFrame([(i,) for i in ids], "nid long"), spark.createDataFrame(list(edges), "src long, dst long")


Y = [(1, 2), (2, 3), (3, 10), (4, 5), (5, 10), (6, 7), (7, 10)]


def test_degree_counts_self_loops_twice(spark):
    n, e = G(spark, [(1, 2), (3, 3)], [4])
    assert rows(graph.degree(n, e), "nid", "degree") == [(1, 1), (2, 1), (3, 2), (4, 0)]


def test_components_keep_isolated_nodes_and_long_chains(spark):
    chain = list(range(100, 400))
    random.Random(1).shuffle(chain)
    n, e = G(spark, list(zip(chain, chain[1:], strict=False)), [5])
    assert {c for _, c in rows(graph.components(n, e), "nid", "comp")} == {5, 100}


def test_forest_breaks_the_last_edge_of_a_ring(spark):
    _, e = G(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 1)])
    assert rows(graph.spanning_forest(e), "src", "dst") == [(1, 2), (1, 6), (2, 3), (3, 4), (4, 5)]


def test_forest_has_nodes_minus_components_edges(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(60)]
    n, e = G(spark, edges)
    comps = {c for _, c in rows(graph.components(n, e), "nid", "comp")}
    forest = graph.spanning_forest(e)
    assert forest.count() == n.count() - len(comps)
    assert rows(graph.components(n, forest), "nid", "comp") == rows(graph.components(n, e), "nid", "comp")


def test_rooted_tree(spark):
    _, e = G(spark, Y)
    root = spark.createDataFrame([(2,)], "nid long")
    assert rows(graph.rooted(e, root), "nid", "parent") == [(1, 2), (2, -1), (3, 2), (4, 5), (5, 10), (6, 7), (7, 10), (10, 3)]


def test_paths_of_a_branch_and_a_ring(spark):
    n, e = G(spark, [*Y, (20, 21), (21, 22), (22, 20)], [30])
    assert rows(paths.paths(n, e), "comp", "ord", "nid") == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (4, 0, 4), (4, 1, 5), (6, 0, 6), (6, 1, 7)]
    assert rows(paths.attach_branches(paths.paths(n, e, 2), e), "ord", "nid") == [(0, 1), (1, 2), (2, 3), (3, 10)]


def test_hops_and_branch_costs(spark):
    n, e = G(spark, [*Y, (10, 11), (11, 12)])
    start = spark.createDataFrame([(1,)], "nid long")
    assert dict(rows(graph.hops(e, start), "nid", "hops"))[12] == 5
    cost = graph.degree(n, e).selectExpr("nid", "cast(degree >= 3 as long) cost")
    assert dict(rows(graph.hops(e, start, cost), "nid", "hops")) == {1: 0, 2: 0, 3: 0, 10: 0, 5: 1, 4: 1, 7: 1, 6: 1, 11: 1, 12: 1}


def points(spark, p):
    return spark.createDataFrame([(i, *map(float, xyz)) for i, xyz in p.items()], "nid long, x double, y double, z double")


def test_angle_is_null_without_a_step_and_never_matches(spark):
    n = points(spark, {1: (0, 0, 0), 2: (0, 0, 0), 3: (1, 0, 0)})
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert rows(repair.bend_angles(n, e), "nid", "angle") == [(2, None)]
    assert repair.sharp_bends(n, e).isEmpty()


def test_bends_in_order_pass_over_nodes_that_lost_an_edge(spark):
    def sequential(bends):
        cut = set()
        for nid, lo, hi in sorted(bends):
            if not cut & {lo, hi}:
                cut.add(nid)
        return sorted(cut)

    r = random.Random(5)
    order = list(range(60))
    r.shuffle(order)
    bends = [(order[i], *sorted((order[i - 1], order[i + 1]))) for i in range(1, 59) if r.random() < 0.8]
    df = spark.createDataFrame(bends, "nid long, lo long, hi long")
    assert [x for (x,) in rows(repair.cut_in_order(df), "nid")] == sequential(bends)


def test_facing_chains_are_joined_once(spark):
    p = {i: (i, 0, 0) for i in range(6)} | {10 + i: (9 + i, 0, 0) for i in range(6)} | {20 + i: (7, 3 + i, 0) for i in range(6)}
    e = [(a + i, a + i + 1) for a in (0, 10, 20) for i in range(5)]
    n, e = points(spark, p), spark.createDataFrame(e, "src long, dst long")
    found = repair.connect_candidates(n, e)
    assert rows(repair.match_ends(found), "src", "dst") == [(5, 10)]


def test_matching_uses_each_end_once(spark):
    c = spark.createDataFrame([(1, 2, 5.0, 180.0), (2, 3, 1.0, 180.0), (3, 4, 2.0, 180.0), (1, 4, 9.0, 180.0)], "src long, dst long, turn double, bend double")
    assert rows(repair.match_ends(c), "src", "dst") == [(1, 4), (2, 3)]


def test_box_join_is_an_equi_join(spark):
    p = points(spark, {i: (i % 7, i % 5, i % 3) for i in range(50)})
    pairs = grid.box_pairs(p, p, 1)
    want = sorted((a.nid, b.nid) for a in p.collect() for b in p.collect() if a.nid != b.nid and max(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) <= 1)
    assert rows(pairs, "nid", "m") == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_takes_the_lower_of_equals(spark):
    n = points(spark, {1: (0, 0, 0), 2: (1, 0, 0), 3: (-1, 0, 0)}).withColumnRenamed("nid", "nid").selectExpr("*", "nid comp")
    assert (1, 2) in rows(grid.nearest_foreign(n, n, 5), "nid", "m")


def test_spliced_tiles(spark):
    r = spark.createDataFrame([(1, 5, 0, 250, 610, 300, 400)], "roi long, x0 long, y0 long, z0 long, sx long, sy long, sz long")
    got = grid.spliced(r, 300, 300)
    assert sorted({(t.z0, t.sz) for t in got.collect()}) == [(250, 50), (300, 300), (600, 50)]
    assert sorted({(t.x0, t.sx) for t in got.collect()}) == [(5, 300), (305, 300), (605, 10)]
    cuts = lambda size, splices: sorted({(t.z0, t.sz) for t in grid.spliced(r, size, splices).collect()})
    assert cuts(300, 150) == [(250, 50), (300, 150), (450, 150), (600, 50)]
    assert cuts(300, 200) == [(250, 300), (550, 100)]
    assert cuts(300, 100_000) == [(250, 300), (550, 100)]


def test_spliced_tiles_of_edge_cases(spark):
    """From the rule itself: every z of a roi is looked at."""
    r = random.Random(8)
    cases = [(i, r.randint(-5, 5), 0, r.randint(-70, 70), r.randint(0, 9), 3, r.randint(0, 90)) for i in range(40)]
    df = spark.createDataFrame(cases, "roi long, x0 long, y0 long, z0 long, sx long, sy long, sz long")
    for size, splices in ((20, 10), (20, 7), (12, 12), (5, 100)):
        want = []
        for roi, x0, y0, z0, sx, sy, sz in cases:
            zs = [z for z in range(z0, z0 + sz) if z == z0 or (z % splices == 0 or z % size == 0 if size % splices == 0 else (z - z0) % size == 0)] + [z0 + sz]
            want += [(roi, x0 + x, y0 + y, a, min(size, sx - x), min(size, sy - y), b - a) for a, b in zip(zs, zs[1:], strict=False) for x in range(0, sx, size) for y in range(0, sy, size)]
        assert rows(grid.spliced(df, size, splices), "roi", "x0", "y0", "z0", "sx", "sy", "sz") == sorted(want)


def test_tiles_cover_a_box_once(spark):
    r = spark.createDataFrame([(1, 0, 0, 0, 25, 13, 30)], "roi long, x0 long, y0 long, z0 long, sx long, sy long, sz long")
    assert sum(t.sx * t.sy * t.sz for t in grid.tiles(r, 10).collect()) == 25 * 13 * 30


def test_flat_tiles_are_zero(spark):
    v = spark.createDataFrame([(0, 0, 0, 7), (1, 0, 0, 7)], "x int, y int, z int, v int").selectExpr("*", "0 t")
    assert {r.norm for r in voxels.min_max(v, "t").collect()} == {0.0}
    assert {r.norm for r in voxels.clip_normalise(v, "t").collect()} == {0.0}


def test_regions_and_skeleton_of_a_cross(spark):
    arm = [(10 + i, 10, 10) for i in range(-9, 10)] + [(10, 10 + i, 10) for i in range(1, 10)]
    v = spark.createDataFrame([(*p, 5) for p in [*arm, (40, 40, 40)]], "x int, y int, z int, v int")
    assert voxels.large_regions(v, 10).count() == len(arm)
    got = voxels.skeleton_segments(v, 3).groupBy("sid").count().collect()
    assert len(got) >= 3


def test_brightest_path_prefers_the_bright_way(spark):
    v = spark.createDataFrame([(x, y, 0, 100 if y == 1 or x in (0, 6) else 1) for x in range(7) for y in range(3)], "x int, y int, z int, v int")
    e = spark.createDataFrame([(1, 0, 0, 0, 6, 0, 0)], "edge long, ax long, ay long, az long, bx long, by long, bz long")
    got = voxels.brightest_paths(e, v, margin=2).orderBy("ord").collect()
    assert (got[0].x, got[-1].x) == (0, 6)
    assert all(max(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) == 1 for a, b in zip(got, got[1:], strict=False))
    assert {r.y for r in got[1:-1]} == {1}


def test_edit_order_and_defaults(spark):
    n = spark.createDataFrame([(1, 0, 0, 0, "a", 0, 1, 1), (2, 0, 0, 0, "a", 0, 1, 1)], "nid long, x long, y long, z long, creator string, type int, checked int, status int")
    e = spark.createDataFrame([(1, 2, "a")], "src long, dst long, creator string")
    log = [(1, 1, "delete_node", 0), (2, 1, "add_node", 0), (3, 2, "uncheck", 0), (4, 2, "change_type", 3)]
    log = spark.createDataFrame(log, "seq long, nid long, action string, arg int")
    got, left = edits.replay(n, e, log)
    assert rows(got, "nid", "creator", "type", "checked") == [(1, "edit", 0, 0), (2, "a", 3, -1)]
    assert left.isEmpty()
    assert rows(edits.last_task(log), "nid", "seq") == [(None, None)]


def test_update_only_where_a_value_differs(spark):
    n = spark.createDataFrame([(1, 1, "d"), (2, 0, "d"), (3, None, "d")], "nid long, checked int, date string")
    c = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "nid long, checked int")
    assert rows(edits.update_nodes(n, c, "now", "checked"), "nid", "checked", "date") == [(1, 0, "now"), (2, 0, "d"), (3, 0, "now")]


def test_swc_needs_one_soma(spark):
    lines = [("a", "# c"), ("a", "1 1 0 0 0 1 -1"), ("a", "2 2 1 0 0 1 1"), ("b", "1 0 0 0 0 1 -1"), ("c", "1 1 0 0 0 1 -1"), ("c", "2 1 0 0 0 1 1"), ("d", "1 1 5 5 5 1 -1")]
    n, e = tables.import_swc(tables.parse_swc(spark.createDataFrame(lines, "file string, value string")))
    assert rows(n, "nid", "file") == [(1, "a"), (2, "a"), (5, "d")]
    assert rows(e, "src", "dst") == [(2, 1)]


def test_swc_round_trip(spark):
    n, e = G(spark, Y)
    n = review.with_components(n.selectExpr("nid", "nid * 1.0 x", "0.0 y", "0.0 z", "cast(nid = 10 as int) type", "1 checked"), e)
    lines = tables.swc_lines(n, e)
    assert {r.file for r in lines.collect()} == {"neuron_10.swc"}
    _, back = tables.import_swc(tables.parse_swc(lines))
    assert rows(graph.canonical(back), "src", "dst") == sorted(Y)


def test_crop_reflects(spark):
    v = spark.createDataFrame([(x, 0, 0, x + 1) for x in range(4)], "x int, y int, z int, v int")
    got = [r.v for r in tables.crop(v, [-2, 0, 0], [8, 1, 1], [4, 1, 1], "reflect").orderBy("x").collect()]
    assert got == [3, 2, 1, 2, 3, 4, 3, 2]
    assert [r.v for r in tables.crop(v, [-2, 0, 0], [4, 1, 1], [4, 1, 1]).orderBy("x").collect()] == [0, 0, 1, 2]


def test_triples_repeat_for_a_seed(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(9)], "id string")
    a, b = rows(augment.triples(ids, 5, 1), "sample", "place", "id"), rows(augment.triples(ids.repartition(3), 5, 1), "sample", "place", "id")
    assert a == b and len(a) == 15 and all(len({i for s, _, i in a if s == k}) == 3 for k in range(1, 6))


def test_edit_stream_equals_batch(spark, tmp_path):
    from tracegraph.streaming.streams import edit_stream, state

    n = spark.createDataFrame([(i, i, 0, 0, "a", 0, 1, 1) for i in range(1, 9)], "nid long, x long, y long, z long, creator string, type int, checked int, status int")
    e = spark.createDataFrame([(i, i + 1, "a") for i in range(1, 8)], "src long, dst long, creator string")
    schema = "seq long, nid long, action string, arg int"
    log = [(1, 3, "delete_node", 0), (2, 4, "uncheck", 0), (3, 3, "add_node", 0), (4, 5, "change_type", 2), (5, 4, "check", 0)]
    for k in range(5):
        spark.createDataFrame(log[k : k + 1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    edit_stream(spark, str(tmp_path / "in"), schema, out, str(tmp_path / "cp")).awaitTermination(120)
    got_n, got_e = state(spark, schema, n, e, out)
    want_n, want_e = edits.replay(n, e, spark.createDataFrame(log, schema))
    c = ["nid", "creator", "type", "checked"]
    assert rows(got_n, *c) == rows(want_n, *c)
    assert rows(got_e, "src", "dst") == rows(want_e, "src", "dst")


def test_tile_stream_gives_segments_and_progress(spark, tmp_path):
    from tracegraph.streaming.streams import tile_stream

    schema = "tile long, x int, y int, z int, v int"
    line = lambda t, x0: [(t, x0 + i, 2, 2, 1000) for i in range(16)] + [(t, x0 + i, 9, 9, 1) for i in range(3)]
    for t in (0, 1):  # two tiles side by side: a line through both is cut at the border
        spark.createDataFrame(line(t, 16 * t), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tile_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out" / "segments"))
    assert sorted(r["count"] for r in found.groupBy("sid").count().collect()) == [16, 16]
    assert rows(spark.read.parquet(str(tmp_path / "out" / "progress")), "batch", "tiles", "segments") == [(0, 1, 1), (1, 1, 1)]


def test_edits_before_a_delete_do_not_count(spark):
    n = spark.createDataFrame([(i, 5, 5, 5, "a", 0, 0, 1) for i in (1, 2, 3)], "nid long, x long, y long, z long, creator string, type int, checked int, status int")
    e = spark.createDataFrame([(1, 2, "a"), (2, 3, "a")], "src long, dst long, creator string")
    log = [(1, 1, "change_type", 3), (2, 1, "check", 0), (3, 1, "delete_node", 0), (4, 1, "add_node", 0), (5, 2, "check", 0)]
    got, left = edits.replay(n, e, spark.createDataFrame(log, "seq long, nid long, action string, arg int"))
    assert rows(got, "nid", "creator", "type", "checked") == [(1, "edit", 0, 0), (2, "a", 0, 1), (3, "a", 0, 0)]
    assert rows(left, "src", "dst") == [(2, 3)]
    assert rows(edits.reopened(n, spark.createDataFrame(log, "seq long, nid long, action string, arg int")), "nid", "checked") == [(1, 0), (2, -1), (3, 0)]


def test_edits_of_edges(spark):
    n = spark.createDataFrame([(i, 0, 0, 0, "a", 0, 0, 1) for i in range(1, 6)], "nid long, x long, y long, z long, creator string, type int, checked int, status int")
    e = spark.createDataFrame([(1, 2, "a"), (3, 2, "a"), (3, 4, "a")], "src long, dst long, creator string")
    log = [
        (1, 1, "add_edge", 5), (2, 2, "delete_edge", 3), (3, 4, "add_edge", 5), (4, 4, "delete_node", None), (5, 1, "add_edge", 9),
        (6, 2, "add_edge", 1), (7, 1, "add_edge", 3), (8, 3, "delete_edge", 1), (9, 4, "add_node", None), (10, 5, "add_edge", 4),
    ]
    log = spark.createDataFrame([(s, a, what, 0, b) for s, a, what, b in log], "seq long, nid long, action string, arg int, other long")
    got, left = edits.replay(n, e, log)
    assert got.count() == 5
    # 4-5 was added before node 4 went and again after it came back; 9 is no node; 1-2 keeps its row
    assert rows(left, "src", "dst", "creator") == [(1, 2, "a"), (1, 5, "edit"), (4, 5, "edit")]


def test_new_centre_is_in_the_largest_part(spark):
    n, e = G(spark, [(1, 9), (2, 9), (2, 3), (3, 4), (5, 9), (5, 6), (6, 7)])
    got = edits.new_centres(n, e, spark.createDataFrame([(9,)], "nid long"))
    assert rows(got, "gone", "centre", "size", "parts") == [(9, 2, 3, 3)]
    assert rows(edits.removed_edges(e, spark.createDataFrame([(9,)], "nid long")), "src", "dst") == [(1, 9), (2, 9), (5, 9)]


def test_chains_in_a_box_and_their_dense_skeleton(spark):
    n = points(spark, {1: (2, 0, 0), 2: (6, 0, 0), 3: (10, 0, 0), 4: (30, 0, 0)})
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    v = spark.createDataFrame([(x, 0, 0, 100 + x) for x in range(20)], "x int, y int, z int, v int")
    got = paths.segments_within(n, e, v, [1, 0, 0], [19, 5, 5], 3)
    assert rows(got, "ord", "nid", "x", "v") == [(0, 1, 1.0, 102), (1, 2, 5.0, 106), (2, 3, 9.0, 110)]
    assert paths.segments_within(n, e, v, [1, 0, 0], [19, 5, 5], 4).isEmpty()
    assert rows(voxels.dense_skeleton(got, v, margin=1), "x", "y", "z") == [(x, 0, 0) for x in range(1, 10)]


def test_coloured_paths_have_no_rings(spark):
    ring = [(i, i + 1) for i in range(1, 12)] + [(12, 1), (3, 20), (20, 21)]
    n, e = G(spark, [*ring, (50, 51), (51, 52)])
    got = paths.coloured_paths(n, e)
    assert 50 not in {r.nid for r in got.collect()}
    assert rows(got.where("comp = 20"), "ord", "nid") == [(-1, 3), (0, 20), (1, 21)]


def test_swc_folder_and_lengths(spark, tmp_path):
    (tmp_path / "a.swc").write_text("# c\n1 1 0 0 0 1 -1\n2 2 1 0 0 1 1\n")
    (tmp_path / "b.swc").write_text("1 0 0 0 0 1 -1\n")
    (tmp_path / "c.txt").write_text("1 1 0 0 0 1 -1\n")
    lines = tables.read_swc(spark, str(tmp_path))
    n, e = tables.import_swc(tables.parse_swc(lines))
    assert rows(n, "file", "nid") == [("a.swc", 1), ("a.swc", 2)] and rows(e, "src", "dst") == [(2, 1)]
    assert rows(tables.total_length(n), "file", "length") == [("a.swc", 6)]
    tables.write_swc(tables.swc_lines(review.with_components(n, e), e), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_mask_volume_and_profile(spark, tmp_path):
    p = spark.createDataFrame([(0, 0, 0), (4, 2, 1), (4, 2, 1), (9, 9, 9), (-1, 0, 0)], "x long, y long, z long")
    tiles = tables.mask_volume(p, [5, 3, 2], 2)
    tables.write_mask(tiles, str(tmp_path / "mask"))
    back = tables.unpacked_mask(spark.read.parquet(str(tmp_path / "mask")), [5, 3, 2], 2)
    assert back.count() == 30 and rows(back.where("m = 1"), "x", "y", "z") == [(0, 0, 0), (4, 2, 1)]
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "k long, s string")
    assert rows(tables.column_profile({"d": d}), "column", "type", "n_rows", "n_null", "is_key") == [("k", "bigint", 3, 0, True), ("s", "string", 3, 1, False)]


def test_rank_filter_equals_brute_force(spark):
    r = random.Random(1)
    size = [7, 5, 1]
    v = {(x, y, z): r.randrange(50) for x in range(7) for y in range(5) for z in range(1) if r.random() < 0.7}

    def at(p):
        q = []
        for k, n in zip(p, size, strict=True):
            while not 0 <= k < n:  # the voxel at the border is the mirror and isn't repeated
                k = -k if k < 0 else 2 * (n - 1) - k
                k = 0 if n == 1 else k
            q.append(k)
        return v.get(tuple(q), 0)

    ball = [(a, b, c) for a in range(-4, 5) for b in range(-4, 5) for c in range(-4, 5) if a * a + b * b + c * c <= 16]
    want = sorted((*p, round(sum(at([i + j for i, j in zip(p, o, strict=True)]) < w for o in ball) / len(ball), 6)) for p, w in v.items())
    got = voxels.rank_filter(spark.createDataFrame([(*p, w) for p, w in v.items()], "x int, y int, z int, v int"), size, 4, tile=3)
    assert rows(got, "x", "y", "z", "rank") == want


def test_process_volume_ends_in_numbered_segments(spark):
    line = [(x, 8, 8, 1000) for x in range(2, 30)] + [(x, 20, 20, 1000) for x in range(2, 30)] + [(40, 40, 40, 1000)]
    dark = [(x, y, 30, 200) for x in range(32) for y in range(32)]
    v = spark.createDataFrame(line + dark, "x int, y int, z int, v int")
    got = voxels.process_volume(v, 32, background=500, least=20)
    assert sorted((r.sid, r["count"]) for r in got.groupBy("sid").count().collect()) == [(1, 28), (2, 28)]
    nodes, edges = tables.ingest_segments(got)
    assert nodes.count() == 56 and edges.count() == 54


def test_voxel_numbers_do_not_collide(spark):
    bad = spark.createDataFrame([(-1, 0, 0, 5)], "x int, y int, z int, v int")
    with pytest.raises(Exception, match="voxel coordinate"):
        voxels.regions(bad).collect()


def test_new_points_by_a_model(spark):
    n = points(spark, {i: (i, 0, 0) for i in range(8)}).selectExpr("nid", "x", "y", "z", "'a' creator", "0 type", "0 checked")
    e = spark.createDataFrame([(i, i + 1, "a") for i in range(7)], "src long, dst long, creator string")
    assert rows(repair.next_points(n, e), "nid", "x", "y", "z") == [(0, -1.0, 0.0, 0.0), (7, 8.0, 0.0, 0.0)]
    up = repair.next_points(n, e, model=lambda track: track[["x4", "y4", "z4"]].to_numpy() * [[0, 0, 1 / 16]])
    nodes, edges = repair.extended(n, e, up)
    assert rows(nodes.where("creator = 'extend'"), "nid", "x", "z") == [(8, 0.0, 1.0), (9, 7.0, 1.0)]
    assert rows(edges.where("creator = 'extend'"), "src", "dst") == [(0, 8), (7, 9)]


def match_histogram(source, reference):
    """{value: value} by cumulative shares."""
    at = lambda vs, v: sum(x <= v for x in vs) / len(vs)
    known = sorted({(at(reference, v), v) for v in reference})
    out = {}
    for v in set(source):
        q = at(source, v)
        below, above = [k for k in known if k[0] <= q], [k for k in known if k[0] >= q]
        lo, hi = (below or above[:1])[-1], (above or below[-1:])[0]
        out[v] = int(round(lo[1] + (q - lo[0]) / (hi[0] - lo[0]) * (hi[1] - lo[1]) if hi[0] > lo[0] else lo[1], 6))
    return out


def test_generated_set(spark, tmp_path):
    r = random.Random(3)
    image = {i: {(x, y): r.randrange(40) * k for x in range(5) for y in range(4)} for k, i in enumerate("ABCD", 1)}
    masks = {i: {p: r.randrange(3) for p in image[i] if r.random() < 0.8} for i in image}
    images = spark.createDataFrame([(i, *p, 0, v) for i, vs in image.items() for p, v in vs.items()], "image string, x int, y int, z int, v int")
    m = spark.createDataFrame([(i, *p, 0, v) for i, vs in masks.items() for p, v in vs.items()], "image string, x int, y int, z int, m int")
    files = spark.createDataFrame([(f"{k}_{i}.tif",) for k in ("img", "mask") for i in "ABCD"], "name string")
    back = spark.createDataFrame([(1, 130 + x, 0, 0, 7) for x in range(3)], "roi long, x int, y int, z int, v int")
    rois = spark.createDataFrame([(1, 0, 0, 0, 256, 128, 128)], "roi long, x0 long, y0 long, z0 long, sx long, sy long, sz long")
    drawn = {}
    for sample, place, i in rows(augment.triples(augment.paired(files), 5), "sample", "place", "id"):
        drawn.setdefault(sample, {})[place] = i
    made = augment.gen_dataset(images, m, files, back, rois, 5, 2)
    want = []
    for sample, d in drawn.items():
        over = {p: max(image[d[1]][p], image[d[2]][p]) for p in image["A"]}
        to = match_histogram(list(over.values()), list(image[d[3]].values()))
        want += [(sample, *p, to[v], min(1, masks[d[1]].get(p, 0) + masks[d[2]].get(p, 0))) for p, v in over.items()]
    assert rows(made.where("sample <= 5"), "sample", "x", "y", "v", "m") == sorted(want)
    assert rows(made.where("sample > 5"), "x", "v", "m") == [(2, 7, 0), (3, 7, 0), (4, 7, 0)]
    augment.write_set(made, str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set")).count() == made.count()
    with pytest.raises(Exception, match="16 bits"):
        voxels.match_histogram(images.selectExpr("v + 65530 v"), images.select("v")).collect()


def test_draws_are_distinct_and_cost_a_row_each(spark):
    ids = spark.range(5).selectExpr("cast(id as string) id")
    got = {}
    for sample, _, i in rows(augment.triples(ids, 600, 7), "sample", "place", "id"):
        got.setdefault(sample, []).append(i)
    assert len(got) == 600 and all(len(set(v)) == 3 for v in got.values())
    assert len({tuple(v) for v in got.values()}) == 60  # every ordered triple
    assert augment.triples(ids.limit(2), 5).count() == 0


@pytest.mark.parametrize("name", ["degree", "annotation_info"])
def test_registered(name):
    from tracegraph.plans.queries import QUERIES, SQL

    assert name in QUERIES and name in SQL


def test_brightest_path_of_many_steps(spark):
    """A bright way that winds through 600 voxels: more steps than any number of rounds once allowed."""
    bright = [(x, y) for x in range(0, 41) for y in range(41) if x % 2 == 0 or y == (40 if x % 4 == 1 else 0)]
    v = spark.createDataFrame([(x, y, 0, 1000 if (x, y) in set(bright) else 0) for x in range(41) for y in range(41)], "x int, y int, z int, v int")
    e = spark.createDataFrame([(1, 0, 0, 0, 40, 40, 0)], "edge long, ax long, ay long, az long, bx long, by long, bz long")
    got = voxels.brightest_paths(e, v, margin=0).orderBy("ord").collect()
    assert len(got) > 600 and {(r.x, r.y) for r in got} <= set(bright)
    assert all(max(abs(a.x - b.x), abs(a.y - b.y)) == 1 for a, b in zip(got, got[1:], strict=False))


def test_long_edges_become_chains(spark):
    n = [(1, 0, 0, 0), (2, 12, 0, 0), (3, 14, 0, 0), (4, 14, 9, 0), (5, 14, 400, 0), (9, 0, 6, 0)]
    n = spark.createDataFrame([(*r, "a", 0, 1) for r in n], "nid long, x long, y long, z long, creator string, type int, checked int")
    e = [(2, 1, "a"), (2, 3, "a"), (3, 4, "seger"), (4, 5, "a"), (1, 9, "a"), (9, 1, "b")]
    v = spark.createDataFrame([(x, 0, 0, 100) for x in range(20)], "x int, y int, z int, v int")
    nodes, edges = repair.interpolated(n, spark.createDataFrame(e, "src long, dst long, creator string"), v)
    # 1-2 along x: voxels 3, 6, 9; 1-9 along y: voxel 3
    new = rows(nodes.where("creator = 'astar'"), "nid", "x", "y", "z")
    assert new[:3] == [(10, 3, 0, 0), (11, 6, 0, 0), (12, 9, 0, 0)] and [r[0] for r in new[3:]] == [13]
    assert rows(edges.where("creator = 'astar'"), "src", "dst") == [(1, 10), (1, 13), (10, 11), (11, 12), (12, 2), (13, 9)]
    assert rows(edges.where("creator <> 'astar'"), "src", "dst") == [(2, 3), (3, 4), (4, 5)]
    assert nodes.count() == 10


def greedy(candidates):
    used, made = set(), []
    for turn, a, b in sorted((t, a, b) for a, b, t, *_ in candidates):
        if a not in used and b not in used:
            used |= {a, b}
            made.append((a, b))
    return sorted(made)


def test_bundles_of_tied_ends_are_joined_in_few_rounds(spark, monkeypatch):
    names = []
    real = repair.saved
    monkeypatch.setattr(repair, "saved", lambda df, name="table", instead_of=None: names.append(name) or real(df, name, instead_of))
    bundle = [(i, 1000 + j, 0.0, 180.0) for i in range(200) for j in range(200) if abs(i - j) < 30]
    r = random.Random(4)
    others = [(2000 + r.randrange(60), 2100 + r.randrange(60), float(r.randrange(4)), 180.0) for _ in range(300)]
    for together, tables_ in ((1 << 16, 10), (50, 60)):
        names.clear()
        c = bundle + others if together > 50 else others
        got = repair.match_ends(spark.createDataFrame(c, "src long, dst long, turn double, bend double"), together)
        assert rows(got, "src", "dst") == greedy(c)
        assert len(names) < tables_


def test_auto_connect_cuts_joins_and_flags(spark):
    """Two facing chains, and a node between them and a third one whose sharp bend goes first; the direction of a chain that
    curves later does not hide that its first step faces away."""
    p = {i: (i, 0, 0) for i in range(6)} | {10 + i: (9 + i, 0, 0) for i in range(6)} | {30: (50, 0, 0), 31: (53, 0, 0), 32: (50, 1, 0)}
    n = points(spark, p).selectExpr("*", "'a' creator", "0 type", "1 checked")
    e = spark.createDataFrame([(a + i, a + i + 1, "a") for a in (0, 10) for i in range(5)] + [(30, 31, "a"), (31, 32, "a")], "src long, dst long, creator string")
    nodes, edges = repair.auto_connect(n, e)
    assert rows(edges.where("creator = 'connector'"), "src", "dst") == [(5, 10)]
    assert rows(edges.where("src >= 30"), "src", "dst") == []
    assert rows(nodes.where("checked = -1"), "nid") == [(5,), (10,)]
    # the first steps lie across the way between the ends, the chains as a whole along it
    q = {0: (0, 0, 0), 1: (0, 1, 0), 2: (-9, 0, 0), 3: (-9, 1, 0), 4: (-29, 1, 0), 10: (3, 0, 0), 11: (3, 1, 0), 12: (12, 0, 0), 13: (12, 1, 0), 14: (32, 1, 0)}
    chains = spark.createDataFrame([(a + i, a + i + 1) for a in (0, 10) for i in range(4)], "src long, dst long")
    assert rows(repair.connect_candidates(points(spark, q), chains), "src", "dst") == []


def test_hops_raise_at_a_limit(spark):
    _, e = G(spark, [(i, i + 1) for i in range(6)])
    start = spark.createDataFrame([(0,)], "nid long")
    with pytest.raises(RuntimeError):
        graph.hops(e, start, limit=3)
    assert dict(rows(graph.hops(e, start, limit=7), "nid", "hops"))[6] == 6


def test_swc_ids_need_no_task_with_all_files(spark):
    lines = [(f"f{i:02}", f"{n + 1} {1 if n == 0 else 2} 0 0 0 1 {n or -1}") for i in range(40) for n in range(i % 3 + 1)]
    n, _ = tables.import_swc(tables.parse_swc(spark.createDataFrame(lines, "file string, value string")))
    base = 0
    want = []
    for i in range(40):
        want += [(f"f{i:02}", base + k + 1) for k in range(i % 3 + 1)]
        base += i % 3 + 3
    assert rows(n, "file", "nid") == want
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "file" not in "".join(x for x in plan.splitlines() if "Exchange SinglePartition" in x or ("Window" in x and "_p" not in x))


def test_hops_equal_a_breadth_first_search(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(r.randrange(60), r.randrange(60)) for _ in range(6)]
    edges += [(100, 101), (101, 102), (102, 100), (5, 5), (1, 2), (200, 201)]  # a ring and a pair out of reach
    n, e = G(spark, edges)
    start = spark.createDataFrame([(0,), (25,), (300,)], "nid long")
    cost = graph.degree(n, graph.canonical(e)).selectExpr("nid", "cast(degree >= 3 as long) cost")
    for costs in (None, cost):
        price = {x: 1 for x in n.toPandas().nid} if costs is None else dict(rows(costs, "nid", "cost"))
        if costs is not None:
            price |= {0: 0, 25: 0}
        want, changed = {0: 0, 25: 0, 300: 0}, True
        while changed:
            changed = False
            for a, b in [*edges, *((b, a) for a, b in edges)]:
                if a in want and want[a] + price[a] < want.get(b, 1e9):
                    want[b], changed = want[a] + price[a], True
        assert dict(rows(graph.hops(e, start, costs), "nid", "hops")) == want


def test_hops_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    names = []
    real = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name="table", instead_of=None: names.append(name) or real(df, name, instead_of))
    _, e = G(spark, [(i, i + 1) for i in range(300)])
    assert dict(rows(graph.hops(e, spark.createDataFrame([(150,)], "nid long")), "nid", "hops")) == {i: abs(i - 150) for i in range(301)}
    assert len(names) < 20


def test_components_join_may_split_a_hub(spark):
    _, e = G(spark, [(0, i) for i in range(1, 50)])
    least = e.groupBy(e.src.alias("u")).agg({"dst": "min"}).withColumnRenamed("min(dst)", "least")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _with_least(e.selectExpr("src u", "dst m"), least)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3


def test_level_info(spark):
    sizes = spark.createDataFrame([(0, 100, 60, 21), (1, 50, 30, 11)], "level long, sx long, sy long, sz long")
    got = tables.level_info(sizes, [-30.9, 12.5, 4.0], [169.1, 72.5, 8.2])
    assert [tuple(round(v, 6) for v in r) for r in rows(got, "px", "py", "pz", "ox", "oy", "oz")] == [(2.0, 1.0, 0.2, -15, 12, 20), (4.0, 2.0, 0.381818, -7, 6, 10)]
    assert [tuple(round(v, 6) for v in r) for r in rows(tables.level_info(sizes), "px", "pz", "oz")] == [(1.0, 1.0, 0), (2.0, 1.909091, 0)]
