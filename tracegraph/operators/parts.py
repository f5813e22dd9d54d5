"""Components dealt out among tasks: small ones are solved whole, many in a task; large ones are left to rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.operators.components import hook
from tracegraph.store import saved, tasks

#: Rows of a component up to which a task always solves it whole, and rows that it gets at a time: half to twice as many.
WHOLE, PART = 1 << 16, 1 << 17


def dealt(rows: DataFrame, key: str = "comp") -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (a written table) with ``part``, the number of the group that their component is solved in, without those
    of large components, and the large components (``key``), or None if there are none.

    Sizes are counted by part; only the components of parts of more than 2 PART rows are counted one by one."""
    n = rows.count()
    parts = max(1, -(-n // PART), min(tasks(rows.sparkSession), n >> 12))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    full = saved(rows.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * PART).select("part"), "full")
    if full.isEmpty():
        return rows, None
    large = rows.join(full, "part", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WHOLE)
    large = saved(large.select(key), "large")
    return (rows, None) if large.isEmpty() else (rows.join(large, key, "left_anti"), large)


def solved(rows: DataFrame, f: Callable[[dict[str, np.ndarray]], list[np.ndarray]], schema: str) -> DataFrame:
    """What ``f`` makes of the columns of each part of ``rows`` (longs, nulls as -1 at places without a meaning)."""
    names, made = [c for c in rows.columns if c != "part"], [x.split()[0] for x in schema.split(", ")]

    def solve(t: pa.Table) -> pa.Table:
        out = f({c: t.column(c).fill_null(-1).to_numpy() for c in names})
        return pa.Table.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=made)

    return rows.groupBy("part").applyInArrow(solve, schema)


def _arcs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in both directions: those of i are at[begin[i]:begin[i + 1]]."""
    u, v = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(u, kind="stable")
    return np.searchsorted(u[order], np.arange(n + 1)), v[order]


def _beside(begin: np.ndarray, at: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): all arcs that leave the nodes of ``front``."""
    n = begin[front + 1] - begin[front]
    first = np.repeat(begin[front] - np.cumsum(n) + n, n)
    return np.repeat(front, n), at[first + np.arange(len(first))]


def chains(c: dict[str, np.ndarray], longer_than: int, given: bool = False, branches: bool = False) -> list[np.ndarray]:
    """comp, ord, nid: the chains of more than ``longer_than`` nodes in what is left of the edges (src, dst), one row for each
    pair, without nodes of degree 3 or more, from the end of lower nid; comp is the chain's least nid. Rows with edge 0 are
    the nodes (src), if they are ``given``; else all ends are. With ``branches``, the node outside that an end hangs on comes
    before or after it."""
    edge = c["edge"] == 1
    ids, at = np.unique(np.stack([c["src"], np.where(edge, c["dst"], c["src"])]), return_inverse=True)
    a, b = at.reshape(2, -1)
    plain = np.bincount(np.concatenate([a[edge], b[edge]]), minlength=len(ids)) < 3
    if given:
        there = np.zeros(len(ids), bool)
        there[a[~edge]] = True
        plain &= there
    between = edge & (a != b)
    inner = between & plain[a] & plain[b]
    begin, nbr = _arcs(a[inner], b[inner], len(ids))
    root = np.arange(len(ids))
    hook(root, a[inner], b[inner])
    ends = np.flatnonzero(np.diff(begin) == 1)  # in order of nid
    own, first = np.unique(root[ends], return_index=True)
    now = start = ends[first]
    last, before = now.copy(), np.full(len(now), -1)
    walk: list[tuple[np.ndarray, np.ndarray]] = []
    chain, size = np.arange(len(now)), np.zeros(len(now), np.int64)
    while len(now):
        walk.append((chain, now))
        size[chain] += 1
        last[chain] = now
        lo = nbr[begin[now]]
        nxt = np.where(lo != before, lo, nbr[begin[now + 1] - 1])
        on = nxt != before
        chain, before, now = chain[on], now[on], nxt[on]
    which = np.concatenate([x for x, _ in walk]) if walk else np.zeros(0, np.int64)
    steps = np.repeat(np.arange(len(walk)), [len(x) for x, _ in walk])
    nodes = np.concatenate([x for _, x in walk]) if walk else np.zeros(0, np.int64)
    if branches:
        begin_all, nbr_all = _arcs(a[between], b[between], len(ids))
        for tip, place in ((start, np.full(len(start), -1)), (last, size)):
            # an end has one neighbour in its chain, and one outside or none
            on = np.flatnonzero(np.diff(begin_all)[tip] == 2)
            tip = tip[on]
            outside = nbr_all[begin_all[tip]] + nbr_all[begin_all[tip] + 1] - nbr[begin[tip]]
            which, steps, nodes = np.concatenate([which, on]), np.concatenate([steps, place[on]]), np.concatenate([nodes, outside])
    long = size[which] > longer_than
    which = which[long]
    return [ids[own[which]], steps[long], ids[nodes[long]]]


def forest(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """src, dst: the edges (src, dst) that Kruskal's algorithm keeps in their order, by Borůvka's rounds."""
    order = np.lexsort([c["dst"], c["src"]])
    src, dst = c["src"][order], c["dst"][order]
    ids, at = np.unique(np.stack([src, dst]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root, kept, e = np.arange(len(ids)), np.zeros(len(src), bool), np.arange(len(src))
    while True:
        ra, rb = root[a[e]], root[b[e]]
        e, ra, rb = (x[ra != rb] for x in (e, ra, rb))
        if not len(e):
            return [src[kept], dst[kept]]
        best = np.full(len(ids), len(src))
        np.minimum.at(best, ra, e)
        np.minimum.at(best, rb, e)
        new = np.unique(best[best < len(src)])
        kept[new] = True
        hook(root, a[new], b[new])


def parents(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """nid, parent: of the trees of ``src`` and ``dst``, from their roots, rows without dst; no row for a root."""
    edge = c["edge"] == 1
    ids, at = np.unique(np.stack([c["src"], np.where(edge, c["dst"], c["src"])]), return_inverse=True)
    a, b = at.reshape(2, -1)
    begin, nbr = _arcs(a[edge], b[edge], len(ids))
    front = np.unique(a[~edge])
    up = np.full(len(ids), -1)
    up[front] = front
    while len(front):
        u, v = _beside(begin, nbr, front)
        new = up[v] == -1
        up[v[new]] = u[new]
        front = np.unique(v[new])
    below = np.flatnonzero((up != -1) & (up != np.arange(len(ids))))
    return [ids[below], ids[up[below]]]


def costs(c: dict[str, np.ndarray], priced: bool) -> list[np.ndarray]:
    """nid, hops: least sums of costs from the starts; rows of kind 0 are edges (src, dst), of kind 1 starts, of kind 2
    nodes with the cost (dst) of leaving them. A step from other nodes, or a start, costs nothing; if not ``priced``, one."""
    edge, start, price = (c["kind"] == k for k in range(3))
    ids, at = np.unique(np.stack([c["src"], np.where(edge, c["dst"], c["src"])]), return_inverse=True)
    a, b = at.reshape(2, -1)
    begin, nbr = _arcs(a[edge], b[edge], len(ids))
    cost = np.full(len(ids), 0 if priced else 1)
    cost[a[price]] = c["dst"][price]
    far = np.full(len(ids), np.iinfo(np.int64).max)
    front = np.unique(a[start])
    far[front], cost[front] = 0, 0 if priced else 1
    while len(front):
        u, v = _beside(begin, nbr, front)
        new = far[u] + cost[u]
        nearer = new < far[v]
        np.minimum.at(far, v[nearer], new[nearer])
        front = np.unique(v[nearer])
    met = np.flatnonzero(far != np.iinfo(np.int64).max)
    return [ids[met], far[met]]


def rooted_forest(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """nid, parent: ``parents`` of the ``forest`` of the edges (src, dst); rows with edge 0 are the roots (src)."""
    edge = c["edge"] == 1
    src, dst = forest({k: c[k][edge] for k in ("src", "dst")})
    roots = c["src"][~edge]
    return parents({"src": np.concatenate([src, roots]), "dst": np.concatenate([dst, roots]), "edge": np.repeat([1, 0], [len(src), len(roots)])})


def coloured(c: dict[str, np.ndarray], more_than: int, longer_than: int, given: bool) -> list[np.ndarray]:
    """comp, ord, nid: ``chains`` with their branches of the ``forest`` of the edges (src, dst), where its components have more
    than ``more_than`` nodes. Rows with edge 0 as for ``chains``."""
    edge = (c["edge"] == 1) & (c["src"] != c["dst"])
    src, dst = forest({k: c[k][edge] for k in ("src", "dst")})
    ids, at = np.unique(np.stack([src, dst]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(ids))
    hook(root, a, b)
    there = np.isin(ids, c["src"][c["edge"] == 0]) if given else np.ones(len(ids), bool)
    large = there & (np.bincount(root[there], minlength=len(ids))[root] > more_than)
    kept = large[a] & large[b]
    return chains({"src": src[kept], "dst": dst[kept], "edge": np.ones(kept.sum(), np.int64)}, longer_than, branches=True)
