"""Steps that make much of few bytes are dealt out among tasks, and what they find is what a plain search finds."""

import heapq
from itertools import product

import numpy as np
import pandas as pd
from pyspark import TaskContext

from tracegraph.operators import repair, voxels


def plain_way(bright, start, end):
    """Costs from ``start`` by Dijkstra's algorithm, in whole numbers of 1e-9, then back by the lowest voxel."""
    moves = [m for m in product((-1, 0, 1), repeat=3) if any(m)]
    price = lambda m, to: round(np.sqrt(sum(map(abs, m))) / bright[to] * 1e9)
    beside = lambda p: [(m, q) for m in moves for q in [tuple(i + j for i, j in zip(p, m))] if all(0 <= i < n for i, n in zip(q, bright.shape))]
    cost, heap = {start: 0}, [(0, start)]
    while heap:
        c, p = heapq.heappop(heap)
        for m, q in beside(p) if c == cost[p] else []:
            if c + price(m, q) < cost.get(q, 1 << 62):
                cost[q] = c + price(m, q)
                heapq.heappush(heap, (cost[q], q))
    way = [end]
    while way[-1] != start:
        way.append(min(q for m, q in beside(way[-1]) if cost[q] + price(m, way[-1]) == cost[way[-1]]))
    return way[::-1], cost[end] / 1e9


def test_cheapest_way_equals_a_plain_search():
    r = np.random.default_rng(5)
    for k in range(12):
        shape = tuple(map(int, r.integers(1, 9, 3)))
        bright = np.maximum(r.integers(0, 4, shape) / 3 if k % 2 else r.random(shape), 1e-3)
        a, b = (tuple(int(r.integers(0, n)) for n in shape) for _ in "ab")
        way, cost = voxels.cheapest_way(bright, a, b)
        want, least = plain_way(bright, a, b)
        assert [tuple(map(int, p)) for p in way] == want and abs(cost - least) < 1e-9


def test_boxes_of_one_block_are_solved_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(voxels, "BESIDE", 8)
    boxes = spark.range(200).selectExpr("id", "id % 40 as _cx", "id % 30 as _cy", "id % 20 as _cz", "array(0L) as _tx", "array(0L) as _ty", "array(0L) as _tz")
    tiles = spark.createDataFrame([(0, 0, 0, b"t")], "tx long, ty long, tz long, tile binary")

    def run(own, near):
        assert near == {(0, 0, 0): b"t"}
        return pd.DataFrame({"id": own["id"], "task": TaskContext.get().partitionId()})

    got = voxels.beside_tiles(boxes, tiles, run, "id long, task int").collect()
    assert sorted(q.id for q in got) == list(range(200)) and len({q.task for q in got}) > 3


def test_boxes_solved_at_once_equal_a_plain_search():
    r = np.random.default_rng(8)
    boxes = []
    for k in range(15):
        shape = tuple(map(int, r.integers(1, 9, 3)))
        bright = np.maximum(r.integers(0, 4, shape) / 3 if k % 2 else r.random(shape), 1e-3)
        boxes.append((bright, *(tuple(int(r.integers(0, n)) for n in shape) for _ in "ab")))
    for (way, cost), box in zip(voxels.cheapest_ways(boxes), boxes):
        want, least = plain_way(*box)
        assert [tuple(map(int, p)) for p in way] == want and abs(cost - least) < 1e-9


def test_edges_between_the_same_places_are_solved_once(spark, monkeypatch):
    """40 edges between two pairs of places: two ways are searched, and each edge is replaced."""
    nodes = [(i, 2 + i % 4 * 9, 3, 1, "a", 0, 0) for i in range(80)]
    n = spark.createDataFrame(nodes, "nid long, x long, y long, z long, creator string, type int, checked int")
    e = spark.createDataFrame([(i, i + 1, "tester") for i in range(0, 80, 2)], "src long, dst long, creator string")
    v = spark.range(600).selectExpr("cast(id % 40 as int) x", "cast(id div 40 % 8 as int) y", "cast(id div 320 as int) z", "cast(id * 7919 % 1000 as int) v")
    searched, plain = [], repair.brightest_paths
    monkeypatch.setattr(repair, "brightest_paths", lambda edges, voxels: searched.append(edges.count()) or plain(edges, voxels))
    new_nodes, new_edges = repair.interpolated(n, e, v)
    assert searched == [2]
    at = {q.nid: (q.x, q.y, q.z) for q in new_nodes.collect()}
    assert len(at) == new_nodes.count()
    links = {}
    for q in new_edges.collect():
        links.setdefault(q.src, []).append(q.dst)
    chains = {}
    for i in range(0, 80, 2):
        way = [i]
        while way[-1] in links:
            (to,) = links[way[-1]]
            way.append(to)
        assert way[-1] == i + 1 and len(way) > 2
        chains.setdefault(i % 4, set()).add(tuple(at[j] for j in way))
    assert all(len(c) == 1 for c in chains.values()) and len(chains) == 2
