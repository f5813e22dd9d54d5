"""Components solved whole in tasks, and large ones by rounds, against plain searches."""

from collections import defaultdict, deque

import numpy as np
import pytest

from tracegraph.operators import components, graph, parts, paths


def _frame(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def _ids(spark, ids):
    return spark.createDataFrame([(x,) for x in ids], "nid long")


def _graph(seed: int) -> list[tuple[int, int]]:
    """Chains, rings, trees and denser graphs, some large, with rising and with random ids."""
    r = np.random.default_rng(seed)
    ids, edges = iter(r.permutation(2000)[:900] * 3 - 500), []
    for n in [2, 3, 5, 40, 120]:
        own = [int(next(ids)) for _ in range(n)]
        edges += zip(own, own[1:], strict=False)
        ring = [int(next(ids)) for _ in range(n)]
        edges += zip(ring, ring[1:] + ring[:1], strict=True)
        tree = [int(next(ids)) for _ in range(n)]
        edges += [(tree[int(r.integers(0, i))], tree[i]) for i in range(1, n)]
    edges += [(10_000 + i, 10_001 + i) for i in range(150)]
    dense = [int(next(ids)) for _ in range(50)]
    edges += [(int(a), int(b)) for a, b in r.choice(dense, (120, 2))]
    return edges + [(b, a) for a, b in edges[:30]]


def _next_to(edges):
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def _search(near, starts, cost=None):
    """Least sums of costs, 0 or 1, from the starts."""
    far, todo = {s: 0 for s in starts}, deque(starts)
    while todo:
        u = todo.popleft()
        step = 1 if cost is None else 0 if u in starts else cost.get(u, 0)
        for v in near[u]:
            if v not in far or far[u] + step < far[v]:
                far[v] = far[u] + step
                todo.append(v)
    return far


def _comp(near):
    comp = {}
    for x in sorted(near):
        if x not in comp:
            comp |= dict.fromkeys(_search(near, [x]), x)
    return comp


@pytest.fixture(params=["tasks", "rounds"])
def way(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(parts, "WHOLE", 4)
        monkeypatch.setattr(parts, "PART", 8)
        monkeypatch.setattr(components, "FEW", 0)
        monkeypatch.setattr(components, "LOCAL", 1)
    return request.param


def test_components_by_contraction_equal_a_search(spark, way):
    edges = _graph(1)
    want = _comp(_next_to(edges))
    got = components.star_edges(_frame(spark, edges + [(7, 7), (None, 3)]).repartition(5)).collect()
    assert len(got) == len(want) and {r.nid: r.comp for r in got} == want


def test_a_long_rising_chain_is_contracted_in_few_rounds(spark, monkeypatch):
    names, real = [], components.saved
    monkeypatch.setattr(components, "FEW", 0)
    monkeypatch.setattr(components, "LOCAL", 1)
    monkeypatch.setattr(components, "saved", lambda df, name="table", instead_of=None: names.append((name, df)) or real(df, name, instead_of))
    got = components.star_edges(spark.range(3000).selectExpr("id src", "id + 1 dst").repartition(4)).collect()
    assert {(r.nid, r.comp) for r in got} == {(i, 0) for i in range(3001)}
    assert 5 < sum(n == "least" for n, _ in names) < 16


def test_forests_equal_kruskal(spark, way):
    edges = _graph(2)
    root, want = {}, set()

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in sorted({(min(e), max(e)) for e in edges if e[0] != e[1]}):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b))
    got = graph.spanning_forest(_frame(spark, edges)).collect()
    assert sorted((r.src, r.dst) for r in got) == sorted(want)


def test_parents_equal_a_search(spark, way):
    edges = _graph(3)
    forest = [(r.src, r.dst) for r in graph.spanning_forest(_frame(spark, edges)).collect()]
    near = _next_to(forest)
    roots = sorted(set(_comp(near).values()))[::2]
    far = _search(near, roots)
    want = {x: next(y for y in near[x] if far[y] < far[x]) if far[x] else -1 for x in far} | {-900: -1}
    got = graph.rooted(_frame(spark, forest), _ids(spark, [*roots, -900])).collect()
    assert len(got) == len(want) and {r.nid: r.parent for r in got} == want


@pytest.mark.parametrize("priced", [False, True])
def test_hops_equal_a_search(spark, way, priced):
    edges = _graph(4)
    near = _next_to(edges)
    starts = [*sorted(near)[::90], -900]
    cost = {x: int(len(near[x]) > 2) for x in near} if priced else None
    prices = spark.createDataFrame([*cost.items()], "nid long, cost long") if priced else None
    got = graph.hops(_frame(spark, edges), _ids(spark, starts), prices).collect()
    want = _search(near, starts, cost)
    assert len(got) == len(want) and {r.nid: r.hops for r in got} == want


def test_chains_equal_a_walk(spark, way):
    edges = _graph(5)
    near, want = _next_to(edges), []
    plain = {x for x in near if len(near[x] | set()) + 2 * ((x, x) in edges) < 3}
    near = {x: near[x] & plain for x in plain}
    comp = _comp(near)
    for c in set(comp.values()):
        ends = sorted(x for x in comp if comp[x] == c and len(near[x]) == 1)
        if len(ends) == 2:
            want += [(c, far, x) for x, far in _search(near, ends[:1]).items() if sum(v == c for v in comp.values()) > 2]
    got = paths.paths(_ids(spark, _next_to(edges)), _frame(spark, edges), 2).collect()
    assert sorted((r.comp, r.ord, r.nid) for r in got) == sorted(want)


def _coloured(forest, nodes, more_than):
    """Chains with their branches of a forest's large components, by plain walks."""
    comp = _comp(near := _next_to(forest))
    n = {c: sum(comp.get(x) == c for x in nodes) for c in set(comp.values())}
    left = {x: {y for y in near[x] if y in nodes} for x in near if x in nodes and n[comp[x]] > more_than}
    plain = {x: {y for y in left[x] if len(left[y]) < 3} for x in left if len(left[x]) < 3}
    want, chains = [], _comp(plain)
    for c in set(chains.values()):
        ends = sorted(x for x in chains if chains[x] == c and len(plain[x]) == 1)
        if not ends:
            continue
        far = _search(plain, ends[:1])
        want += [(c, k, x) for x, k in far.items()]
        for tip, k in zip(ends, (-1, len(far)), strict=True):
            want += [(c, k, y) for y in left[tip] - plain[tip]]
    return sorted(want)


@pytest.mark.parametrize("given", [False, True])
def test_coloured_paths_equal_plain_walks_and_find_components_once(spark, way, given, monkeypatch):
    edges, calls, real = _graph(6), [], paths.star_edges
    monkeypatch.setattr(paths, "star_edges", lambda *a: calls.append(a) or real(*a))
    forest = [(r.src, r.dst) for r in graph.spanning_forest(_frame(spark, edges)).collect()]
    nodes = {x for e in edges for x in e if not given or x % 11}
    got = paths.coloured_paths(_ids(spark, nodes) if given else None, _frame(spark, edges))
    assert sorted((r.comp, r.ord, r.nid) for r in got.collect()) == _coloured(forest, nodes, 10)
    assert len(calls) == 1 or way == "rounds"


@pytest.mark.parametrize("given", [False, True])
def test_chains_with_branches_equal_those_attached_after(spark, way, given):
    edges = _frame(spark, _graph(7) + [(3, 3), (10_000, 10_000)])
    ids = graph.adjacency(edges).select("nid").distinct()
    nodes = ids.where("nid % 13 <> 0") if given else ids
    want = paths.attach_branches(paths.paths(nodes, edges, 1), edges).collect()
    got = paths.paths(nodes if given else None, edges, 1, branches=True).collect()
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_rooted_forests_equal_the_two_steps(spark, way):
    edges = _frame(spark, _graph(8) + [(3, 3)])
    comp = components.star_edges(edges).cache()
    lone = spark.createDataFrame([(-900, -900)], "comp long, nid long")
    roots = comp.where("comp % 2 = 0").groupBy("comp").agg({"nid": "max"}).withColumnRenamed("max(nid)", "nid").unionByName(lone).cache()
    want = graph.rooted(graph.spanning_forest(edges, comp), roots.select("nid"), comp).collect()
    got = graph.rooted_forest(edges, roots, comp).collect()
    assert len(want) > 100 and sorted(got) == sorted(want)
