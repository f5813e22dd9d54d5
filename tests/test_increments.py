"""Work that grows with what changed: trees in few rounds, edits and tiles as streams, components after edits."""

import random

import numpy as np

from tracegraph.functions.geometry import AXES
from tracegraph.operators import edits, graph, grid, repair, voxels
from tracegraph.store import saved
from tracegraph.streaming import streams


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def comb(n):
    return [(i, i + 1) for i in range(n)] + [(i, 10_000 + i) for i in range(n + 1)]


def test_hops_of_a_comb_take_few_rounds(spark, monkeypatch):
    names = []
    real = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name="table", instead_of=None: names.append(name) or real(df, name, instead_of))
    n = 2000
    e = spark.createDataFrame(comb(n), "src long, dst long")
    start = spark.createDataFrame([(700,)], "nid long")
    want = {i: abs(i - 700) for i in range(n + 1)} | {10_000 + i: abs(i - 700) + 1 for i in range(n + 1)}
    assert dict(rows(graph.hops(e, start), "nid", "hops")) == want
    assert sum(x in ("tour", "depth", "chains", "front") for x in names) < 30


def test_hops_of_a_comb_closed_to_a_ring_take_few_rounds(spark, monkeypatch):
    """A comb hangs on a ring and has two starts: neither is a tree with one start, and a frontier would take a round a tooth."""
    names = []
    real = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name="table", instead_of=None: names.append(name) or real(df, name, instead_of))
    n = 300
    e = comb(n) + [(n, 30_000), (30_000, 30_001), (30_001, n)]
    starts = [0, 10_040]
    at = lambda i: min(i, abs(i - 40) + 1)
    want = {i: at(i) for i in range(n + 1)} | {10_000 + i: at(i) + 1 for i in range(n + 1)} | {10_040: 0, 30_000: at(n) + 1, 30_001: at(n) + 1}
    got = graph.hops(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame([(s,) for s in starts], "nid long"))
    assert dict(rows(got, "nid", "hops")) == want
    assert sum(x in ("raked", "compressed") for x in names) < 24
    assert sum(x == "front" for x in names) < 8


def test_hops_of_mixed_components(spark):
    """A tree with one start, one with two, a ring with trees on it, and a part without a start, against a search."""
    r = random.Random(6)
    e = comb(5) + [(20_000 + i, 20_000 + i // 2) for i in range(1, 30)] + [(30_000 + i, 30_000 + (i + 1) % 9) for i in range(9)] + [(30_000 + i, 30_100 + i) for i in range(9)] + [(40_000, 40_001)]
    starts, cost = [3, 20_007, 20_021, 30_104, 50_000], {v: r.randrange(2) for ends in e for v in ends}
    adj = {}
    for a, b in e:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    for with_cost in (False, True):
        far = dict.fromkeys(starts, 0)
        open_ = list(starts)
        while open_:
            u = open_.pop(0)
            for v in adj.get(u, ()):
                new = far[u] + ((0 if u in starts else cost[u]) if with_cost else 1)
                if new < far.get(v, 1 << 30):
                    far[v] = new
                    open_.append(v)
        nodes = spark.createDataFrame(list(cost.items()), "nid long, cost long") if with_cost else None
        got = graph.hops(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame([(s,) for s in starts], "nid long"), nodes)
        assert dict(rows(got, "nid", "hops")) == far


def test_components_after_edits_equal_the_whole_run(spark, monkeypatch):
    r = random.Random(9)
    nodes = list(range(120))
    now = {tuple(sorted(r.sample(range(k, k + 20), 2))) for k in range(0, 120, 20) for _ in range(22)}
    frame = lambda es: spark.createDataFrame(sorted(es), "src long, dst long")
    ids = lambda ns: spark.createDataFrame([(n,) for n in ns], "nid long")
    comp = saved(graph.components(ids(nodes), frame(now)), "comp")
    seen = []
    real = graph.star_edges
    monkeypatch.setattr(graph, "star_edges", lambda e: seen.append({v for row in e.collect() for v in (row.src, row.dst)}) or real(e))
    for step in range(6):
        block = 20 * r.randrange(6)
        near = sorted(x for x in now if block <= x[0] < block + 20)
        cut = set(r.sample(near, min(len(near), 3)))
        new = {(r.randrange(block, block + 20), 1000 + step)} | {tuple(sorted(r.sample(range(block, block + 20), 2)))} if step % 3 else {(block, (block + 45) % 120)}
        new = {tuple(sorted(x)) for x in new} - now
        gone = [block + 7] if step % 4 == 1 and block + 7 in nodes else []
        nodes = sorted((set(nodes) | {v for x in new for v in x}) - set(gone))
        now = {x for x in (now - cut) | new if not set(x) & set(gone)}
        touched = {row.comp for row in comp.collect() if row.nid in {v for x in cut | new for v in x} | set(gone)}
        untouched = {row.nid for row in comp.collect()} - {row.nid for row in comp.collect() if row.comp in touched}
        seen.clear()
        after = saved(graph.update_components(comp, frame(now), frame(new) if new else None, frame(cut) if cut else None, ids(gone) if gone else None), "comp")
        assert not set().union(*seen) & untouched
        want = real(frame(now)).collect()
        want = {n: n for n in nodes} | {row.nid: row.comp for row in want}
        assert dict(rows(after, "nid", "comp")) == want
        comp = after


# the state of edits


SCHEMA = "seq long, nid long, action string, arg int, other long"


def log(n, seed=3):
    r = random.Random(seed)
    kinds = ["delete_node", "add_node", "uncheck", "check", "change_type", "add_edge", "delete_edge"]
    return [(i, r.randrange(1, 12), r.choice(kinds), r.randrange(8), r.randrange(1, 12)) for i in range(n)]


def graph_of(spark):
    n = spark.createDataFrame([(i, i, 0, 0, "a", 0, 1, 1) for i in range(1, 9)], "nid long, x long, y long, z long, creator string, type int, checked int, status int")
    return n, spark.createDataFrame([(i, i + 1, "a") for i in range(1, 8)], "src long, dst long, creator string")


def sequential(nodes, pairs, edits_):
    """One edit at a time. A node that is added again starts afresh; a pair that was there all along keeps its row."""
    nodes = {n: [0, 1] for n in nodes}
    first, pairs = set(nodes), {frozenset(p): "a" for p in pairs}
    for _, nid, action, arg, other in edits_:
        if action == "delete_node":
            nodes.pop(nid, None)
            pairs = {p: c for p, c in pairs.items() if nid not in p}
        elif action == "add_node" and nid not in nodes:
            nodes[nid] = [0, 0]
        elif action == "change_type" and nid in nodes:
            nodes[nid][0] = arg
        elif action in ("check", "uncheck") and nid in nodes:
            nodes[nid][1] = 1 if action == "check" else -1
        elif action == "add_edge" and nid in nodes and other in nodes:
            pairs.setdefault(frozenset((nid, other)), "edit")
        elif action == "delete_edge":
            pairs.pop(frozenset((nid, other)), None)
    return nodes, pairs, first


def test_state_between_batches(spark, tmp_path):
    n, e = graph_of(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    edits_ = log(70)
    wide = []
    for k in range(0, 70, 10):
        spark.createDataFrame(edits_[k : k + 10], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        streams.edit_stream(spark, source, SCHEMA, out, str(tmp_path / "cp")).awaitTermination(120)  # a restart each time
        wide.append(streams._Folder(spark, f"{out}/state").spans())
    assert wide == [[(0, 0)], [(0, 1)], [(0, 1), (2, 2)], [(0, 3)], [(0, 3), (4, 4)], [(0, 3), (4, 5)], [(0, 3), (4, 5), (6, 6)]]
    assert len(list((tmp_path / "out" / "state").iterdir())) == 3  # merged tables are gone
    whole = edits.replay(n, e, spark.createDataFrame(edits_, SCHEMA))
    same = ["nid", "x", "creator", "type", "checked"]
    got = streams.state(spark, SCHEMA, n, e, out)
    assert rows(got[0], *same) == rows(whole[0], *same) and rows(got[1], "src", "dst", "creator") == rows(whole[1], "src", "dst", "creator")
    # a batch that runs again, before or after its merge, and edits that come twice
    for k in (6, 3):
        streams.submit(spark.createDataFrame(edits_[10 * k : 10 * k + 10], SCHEMA), k, out)
    streams.submit(spark.createDataFrame(edits_[30:50], SCHEMA), 7, out)
    assert streams._Folder(spark, f"{out}/state").spans() == [(0, 7)]
    got = streams.state(spark, SCHEMA, n, e, out)
    assert rows(got[0], *same) == rows(whole[0], *same) and rows(got[1], "src", "dst", "creator") == rows(whole[1], "src", "dst", "creator")


def test_replay_equals_one_edit_at_a_time(spark):
    n, e = graph_of(spark)
    for seed in range(2):
        # adds of nodes that are there do nothing, so that both readings of a log agree
        there, edits_ = set(range(1, 9)), []
        for x in log(40, seed):
            if x[2] == "add_node" and x[1] in there or x[2] in ("change_type", "check", "uncheck") and x[1] not in there or x[2] == "add_edge" and (not {x[1], x[4]} <= there or x[1] == x[4]):
                continue
            there = there - {x[1]} if x[2] == "delete_node" else there | {x[1]} if x[2] == "add_node" else there
            edits_.append(x)
        nodes, pairs, _ = sequential(range(1, 9), [(i, i + 1) for i in range(1, 8)], edits_)
        got = edits.replay(n, e, spark.createDataFrame(edits_, SCHEMA))
        assert {(a, b, c) for a, b, c in rows(got[0], "nid", "type", "checked")} == {(k, *v) for k, v in nodes.items()}
        assert {frozenset(x) for x in rows(got[1], "src", "dst")} == set(pairs)


# tiles


def cross_volume(spark):
    v = {}
    for x in range(2, 60):
        v[x, 8, 8] = v[x, 24, 8] = 1000
    for y in range(3, 30):
        v[40, y, 20] = 900
    for p in np.ndindex(3, 3, 3):
        v[20 + p[0], 50 + p[1], 3 + p[2]] = 800
    for p in np.ndindex(4, 4, 3):  # something dark in every tile
        v[tuple(16 * k + 1 for k in p)] = 3
    return spark.createDataFrame([(*map(int, p), x) for p, x in v.items()], "x int, y int, z int, v int")


def chains(df):
    found = {}
    for sid, ord_, *p in rows(df, "sid", "ord", *AXES):
        found.setdefault(sid, []).append((ord_, tuple(p)))
    return sorted(min(c, c[::-1]) for c in ([p for _, p in sorted(x)] for x in found.values()))


def test_clipped_tiles_and_their_stream(spark, tmp_path):
    image, size = [62, 58, 35], 16
    v = cross_volume(spark)
    batch = voxels.process_volume(v, size, background=100, least=5, clip=size, image=image)
    got = chains(batch)
    border = lambda p: any(k % size in (0, size - 1) or k == n - 1 for k, n in zip(p, image, strict=True))
    assert got and not any(border(p) for c in got for p in c)
    assert all(len({tuple(k // size for k in p) for p in c}) == 1 for c in got)
    want = sorted([(x, y, 8) for x in range(a, b)] for y in (8, 24) for a, b in ((2, 15), (17, 31), (33, 47), (49, 60)))
    assert [c for c in got if c[0][2] == 8] == want
    # the stream gets haloed tiles, a file of some whole tiles each
    tiles = saved(grid.haloed(v, size, 4), "haloed")
    for k in range(3):
        part = tiles.where(f"(tx + ty + tz) % 3 = {k}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in tiles.dtypes)
    streams.tile_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), background=100, size=size, image=image, least=5).awaitTermination(200)
    assert chains(spark.read.parquet(str(tmp_path / "out" / "segments"))) == got
    progress = spark.read.parquet(str(tmp_path / "out" / "progress"))
    assert sum(r.tiles for r in progress.collect()) == tiles.select("tx", "ty", "tz").distinct().count()
    # ends on either side of a border meet again
    links = repair.match_ends(voxels.border_links(batch, size))
    name = lambda p: (p[0] * voxels.BASE + p[1]) * voxels.BASE + p[2]
    across = {(name((a, y, 8)), name((a + 3, y, 8))) for y in (8, 24) for a in (14, 30, 46)}
    assert across <= set(rows(links, "src", "dst"))


def test_regions_of_keys_do_not_touch(spark):
    v = spark.createDataFrame([(x, 0, 0, 1) for x in range(10)], "x int, y int, z int, v int").selectExpr("*", "x div 4 t")
    assert rows(voxels.large_regions(v, 4, "t").select("region").distinct(), "region") == [(0,), (4 * voxels.BASE**2,)]
