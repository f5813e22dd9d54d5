"""Repair rules: sharp bends are cut, ends that face each other are joined, long edges are interpolated."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracegraph.functions.geometry import AXES, angle, every_third, norm, step
from tracegraph.operators.blocks import millionths, places, within
from tracegraph.operators.components import star_edges
from tracegraph.operators.dense import with_crops
from tracegraph.operators.edits import patch
from tracegraph.operators.graph import adjacency, canonical, degree
from tracegraph.operators.grid import ends, neighbours
from tracegraph.operators.paths import walk_from_ends
from tracegraph.operators.voxels import brightest_paths
from tracegraph.operators.numbers import numbered
from tracegraph.operators.octree import few_checked
from tracegraph.sources.tables import not_by
from tracegraph.store import saved, tasks


def edge_lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, length): Euclidean lengths, to 6 places."""
    return ends(edges, nodes).select("src", "dst", F.round(norm(step("a", "b")), 6).alias("length"))


def bend_angles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nid, lo, hi, angle) of every node with two edges: the angle between the ways to its neighbours; null if a
    neighbour lies at its own place."""
    of = neighbours(nodes, edges).where("nid <> nbr").select("nid", "nbr", *(F.col(f"a{k}") for k in AXES), *(F.col(f"b{k}") for k in AXES))
    bent = degree(nodes.select("nid"), edges).where("degree = 2").select("nid")
    of = of.join(bent, "nid", "left_semi")
    left = of.select("nid", F.col("nbr").alias("lo"), *(F.col(f"a{k}") for k in AXES), *(F.col(f"b{k}").alias(f"l{k}") for k in AXES))
    right = of.select("nid", F.col("nbr").alias("hi"), *(F.col(f"b{k}").alias(f"h{k}") for k in AXES))
    both = left.join(right, "nid").where("lo < hi")
    return both.select("nid", "lo", "hi", angle(step("a", "l"), step("a", "h")).alias("angle"))


def sharp_bends(nodes: DataFrame, edges: DataFrame, below: float = 100.0) -> DataFrame:
    """(nid, lo, hi, angle) of the nodes to cut in one pass."""
    return bend_angles(nodes, edges).where(F.col("angle") < below)


#: Rows that compete, directly or through others, up to which one task takes them in their order.
TOGETHER = 1 << 20
#: The share of the rows that a round leaves from which on their components are asked for.
SHRUNK = 0.9


def _by_tasks(rows: DataFrame, links: DataFrame, together: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with src) of components of ``links`` (src, dst) of up to ``together`` rows, with the number ``task`` of about
    as many rows of whole components, and the other rows."""
    comp = star_edges(links).select(F.col("nid").alias("src"), "comp")
    own = saved(rows.join(comp, "src", "left").withColumn("comp", F.coalesce("comp", "src")), "competing")
    sizes = saved(own.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    small = sizes.where(F.col("n") <= together)
    parts = 1 + (small.agg(F.sum("n")).first()[0] or 0) // together
    few = own.join(small.select("comp"), "comp", "left_semi").withColumn("task", F.pmod(F.xxhash64("comp"), F.lit(parts)))
    return few.select(*rows.columns, "task"), own.join(sizes.where(F.col("n") > together), "comp", "left_semi").select(*rows.columns)


def _cut_in_order(group: pd.DataFrame) -> pd.DataFrame:
    cut: set[int] = set()
    group = group.sort_values("src")
    for src, lo, hi in zip(*(group[c].tolist() for c in ("src", "lo", "hi")), strict=True):
        if lo not in cut and hi not in cut:
            cut.add(src)
    return pd.DataFrame({"nid": sorted(cut)}, dtype="int64")


def cut_in_order(bends: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(nid): the bends that are cut when they are visited by nid and one that has lost an edge is passed over.

    Rounds: bends without a lower neighbouring bend are cut, and rule out their higher ones; both are done, and the others
    go on. Once no more than ``together`` are left they are visited in one task; of more, after a round that leaves most,
    those that hang together in numbers up to it.
    """
    left, made = saved(bends.select(F.col("nid").cast("long").alias("src"), "lo", "hi"), "bends"), []
    while n := left.count():
        if n <= together:
            made.append(left.groupBy(F.lit(0).alias("task")).applyInPandas(_cut_in_order, "nid long"))
            break
        links = left.select("src", F.explode(F.array("lo", "hi")).alias("dst")).join(left.select(F.col("src").alias("dst")), "dst")
        lower = saved(links.where("dst < src"), "lower")
        now = saved(left.select("src").join(lower, "src", "left_anti"), "bends_cut")
        out = lower.join(now.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src")
        left = saved(left.join(now.union(out), "src", "left_anti"), "bends", instead_of=left)
        made.append(now.withColumnRenamed("src", "nid"))
        if left.count() > max(together, n * SHRUNK):
            links = left.select("src", F.explode(F.array("lo", "hi")).alias("dst")).join(left.select(F.col("src").alias("dst")), "dst")
            small, left = _by_tasks(left, links, together)
            made.append(small.groupBy("task").applyInPandas(_cut_in_order, "nid long"))
            left = saved(left, "bends")
    return reduce(DataFrame.unionAll, made) if made else left.select(F.col("src").alias("nid"))


def remove_bends(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """``edges`` without those at the nodes of ``cut``."""
    return edges.join(cut.withColumnRenamed("nid", "src"), "src", "left_anti").join(cut.withColumnRenamed("nid", "dst"), "dst", "left_anti").select(*edges.columns)


def connect_candidates(nodes: DataFrame, edges: DataFrame, half: float = 6, turn: float = 45.0, open_: float = 120.0, walk: int = 5) -> DataFrame:
    """(src, dst, turn, bend): pairs of terminals near each other that face each other.

    An end's direction runs inwards along its chain: the sum of every third step of its walk. Two ends fit if one's
    direction is within ``turn`` degrees of the other's reversed, and the way between them meets the first step of both
    chains at ``open_`` degrees or more. An end on the other's walk is no candidate.
    """
    tips, walks = _ends_and_walks(nodes, edges, walk)
    return _facing(tips, walks, half, turn, open_)


def _ends_and_walks(nodes: DataFrame, edges: DataFrame, walk: int) -> tuple[DataFrame, DataFrame]:
    """Terminals (nid, x, y, z) with their direction (dx, dy, dz) and first step (fx, fy, fz), and their walks (nid, at). One
    whose direction or first step has no length faces nothing and is left out."""
    tips = saved(degree(nodes, edges).where("degree = 1").select("nid", *AXES), "tips")
    walks = saved(walk_from_ends(tips, edges, walk).join(nodes.select(F.col("nid").alias("at"), *AXES), "at"), "walks")
    nxt = walks.select("nid", (F.col("step") - 1).alias("step"), *(F.col(k).alias(f"n{k}") for k in AXES))
    steps = walks.join(nxt, ["nid", "step"]).where("step % 3 = 0")
    moved = {k: F.col(f"n{k}") - F.col(k) for k in AXES}
    ways = steps.groupBy("nid").agg(
        *(F.sum(moved[k]).cast("double").alias(f"d{k}") for k in AXES), *(F.max(F.when(F.col("step") == 0, moved[k])).cast("double").alias(f"f{k}") for k in AXES)
    )
    ways = ways.where(" and ".join("abs({0}x) + abs({0}y) + abs({0}z) > 0".format(p) for p in "df"))
    own = tips.select("nid", *(F.col(k).cast("double").alias(k) for k in AXES))
    met = walks.where("at <> nid").join(tips.select(F.col("nid").alias("at")), "at", "left_semi").select("nid", "at")
    return saved(own.join(ways, "nid"), "ends"), saved(met, "met")


def _angles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``angle`` of vectors (3 x n) that have a length."""
    (a, b, c), (x, y, z) = u, v
    p, q, r = b * z - c * y, c * x - a * z, a * y - b * x
    return millionths(np.degrees(np.arctan2(np.sqrt(p * p + q * q + r * r), a * x + b * y + c * z))) / 1e6


def _facing_of(a: pa.Table, b: pa.Table, half: float, turn: float, open_: float) -> pa.Table:
    """The candidates (src, dst, turn, bend) of which the lesser end is in ``a``, the other in ``b``."""

    def vectors(t: pa.Table, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        v = places(t, prefix)
        return v, v / np.sqrt((v * v).sum(0))

    nid, m, met, of = (t.column(c).to_numpy() for t, c in ((a, "nid"), (b, "ofnid"), (a, "met"), (b, "ofmet")))
    at, to = places(a), places(b, "of")
    (d, u), (e, v), (f, p), (g, q) = vectors(a, "d"), vectors(b, "ofd"), vectors(a, "f"), vectors(b, "off")
    least, most = np.cos(np.radians(turn)) - 1e-6, np.cos(np.radians(open_)) + 1e-6
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in "qqdd"]
    for x, y in within(at, to, half):
        kept = (nid[x] < m[y]) & (met[x] != m[y]) & (of[y] != nid[x])
        x, y = x[kept], y[kept]
        # first by cosines, a little wider, which is fast; what they leave, some hundredths, by the angles
        kept = -(u[:, x] * v[:, y]).sum(0) >= least
        x, y = x[kept], y[kept]
        across = to[:, y] - at[:, x]
        beyond = most * np.sqrt((across * across).sum(0))
        # no match where the ends lie at one place
        kept = ((p[:, x] * across).sum(0) <= beyond) & (-(q[:, y] * across).sum(0) <= beyond) & across.any(0)
        x, y, across = x[kept], y[kept], across[:, kept]
        turns = _angles(d[:, x], -e[:, y])
        bends = np.minimum(_angles(f[:, x], across), _angles(g[:, y], -across))
        kept = (turns <= turn) & (bends >= open_)
        for c, values in zip(out, (nid[x], m[y], turns, bends), strict=True):
            c.append(values[kept])
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["src", "dst", "turn", "bend"])


def _unit() -> list:
    size = norm([F.col("d" + k) for k in AXES])
    return [F.col("d" + k) / size for k in AXES]


def _facing(tips: DataFrame, met: DataFrame, half: float, turn: float, open_: float) -> DataFrame:
    """``connect_candidates`` of the ends, and the ends on their walks, that ``_ends_and_walks`` gives.

    An end goes to the cell of its place and, for a small ``turn``, of its direction reversed, and to all cells of places and
    directions that it reaches: there a task finds the pairs, which move on only if they fit. A cell of many ends is dealt
    into parts of PART.
    """
    wide, cell = half * 1.0001, 2.001 * (half or 1)
    apart = 2 * np.sin(np.radians(min(turn, 180.0)) / 2) + 1e-6  # between the heads of unit vectors
    size = 4 * apart
    reached = [(F.col(k), wide, cell) for k in AXES] + [(c, apart, size) for c in _unit() if apart < 0.25]
    own = [(F.col(k), cell) for k in AXES] + [(-c, size) for c in _unit() if apart < 0.25]
    keys = [f"c{i}" for i in range(len(own))]
    a = tips.join(met.withColumnRenamed("at", "met"), "nid", "left").withColumn("met", F.coalesce("met", "nid"))
    b = a
    for c, (at, reach, edge), (to, _) in zip(keys, reached, own, strict=True):
        a = a.withColumn(c, F.explode(F.sequence(F.floor((at - reach) / edge), F.floor((at + reach) / edge))))
        b = b.withColumn(c, F.floor(to / edge))
    # only cells that hold an end; one of many is dealt into parts
    held = few_checked(saved(b.groupBy(keys).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")), "held"))
    a = a.join(held, keys).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    b = b.join(held, keys).withColumn("part", F.pmod(F.xxhash64("nid"), "parts")).drop("parts")
    keys = [*keys, "part"]
    n, of = tasks(tips.sparkSession), ["of" + c for c in keys]
    # columns of its own: Spark loses those that both sides have in common
    b = b.select(*(F.col(c).alias("of" + c) for c in b.columns))
    pairs = a.repartition(n, *keys).groupBy(keys).cogroup(b.repartition(n, *of).groupBy(of))
    return pairs.applyInArrow(partial(_facing_of, half=half, turn=turn, open_=open_), "src long, dst long, turn double, bend double")


#: Ends of a cell in one part, and ends that one is compared with, on average, up to which all turns are looked at at once.
PART, FACED = 1 << 14, 64
#: Halvings of a turn that are tried.
HALVINGS = 12


def _first_turn(tips: DataFrame, half: float, turn: float) -> float:
    """``turn`` or, where ends in an end's box face it within that by more than FACED on average, a half, a quarter and so on
    of it. Counted by cells of places and directions, as directions may lie in a plane or be few."""
    turns = [turn / 2**j for j in range(HALVINGS)]
    sizes = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(float(2 * np.sin(np.radians(min(t, 180.0)) / 2)) or 1.0).alias("size")) for j, t in enumerate(turns)))
    at = tips.select(*(F.floor(F.col(k) / (half or 1)).alias(k) for k in AXES), *(c.alias("u" + k) for c, k in zip(_unit(), AXES, strict=True)))
    at = at.withColumn("s", F.explode(sizes)).withColumn("by", F.explode(F.array(F.lit(1), F.lit(-1))))
    cells = at.groupBy("s.j", *AXES, *(F.floor(F.col("by") * F.col("u" + k) / F.col("s.size")).alias("u" + k) for k in AXES))
    cells = cells.agg(F.count_if(F.col("by") > 0).cast("double").alias("n"), F.count_if(F.col("by") < 0).alias("m"))
    held = {r.j: 16 * r.pairs / r.n for r in cells.groupBy("j").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum("n").alias("n")).collect()}
    return next((t for j, t in enumerate(turns) if held.get(j, 0) <= FACED), turns[-1])


#: Rows of ends and of pairs of kinds, of one component or some, that one task takes.
HELD = 1 << 21


def joined_ends(nodes: DataFrame, edges: DataFrame, half: float = 6, turn: float = 45.0, open_: float = 120.0, walk: int = 5) -> DataFrame:
    """``match_ends`` of ``connect_candidates``, without making all of these where they are many.

    Ends at one place with the same direction and first step are a kind: kinds are paired, not ends. As candidates are taken
    in order of their turn, those of a small turn are matched first, and ends that are joined take no further part; the
    others go on with a wider turn.
    """
    tips, met = _ends_and_walks(nodes, edges, walk)
    alike = [p + k for p in ("", "d", "f") for k in AXES]
    kinds = saved(tips.groupBy(alike).agg(F.min("nid").alias("kind")), "kinds")
    ends = tips.join(kinds, alike).select("kind", "nid").join(met.withColumnRenamed("at", "met"), "nid", "left")
    ends = saved(ends.select("kind", "nid", F.coalesce("met", "nid").alias("met")), "ends_of")
    kinds, alone = kinds.withColumnRenamed("kind", "nid"), met.limit(0)
    now, made = _first_turn(kinds, half, turn), []
    while True:
        pairs = saved(_facing(kinds, alone, half, now, open_).select("src", "dst", "turn"), "pairs")
        found, ends = _matched(pairs, ends, now)
        made += found
        if now >= turn:
            return reduce(DataFrame.unionAll, made)
        kinds = saved(kinds.join(ends.select(F.col("kind").alias("nid")).distinct(), "nid", "left_semi"), "kinds")
        now = min(turn, max(2 * now, _first_turn(kinds, half, turn)))


def _matched(pairs: DataFrame, ends: DataFrame, turn: float) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the edges made among ``ends`` (kind, nid, met) by ``pairs`` of kinds (src, dst, turn) of up to ``turn``, and
    the ends that are left. Components of pairs are matched whole in tasks; where one has too many rows, first those of its
    pairs that turn less."""
    made: list[DataFrame] = []
    while True:
        now = turn
        while True:
            some = pairs.where(F.col("turn") <= now)
            comp = star_edges(some)
            own = ends.join(comp.select(F.col("nid").alias("kind"), "comp"), "kind")
            links = some.join(comp.select(F.col("nid").alias("src"), "comp"), "src")
            rows = own.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).unionAll(links.groupBy("comp").agg(F.count(F.lit(1)).alias("n")))
            sizes = saved(rows.groupBy("comp").agg(F.sum("n").alias("n")), "sizes")
            most, total = sizes.agg(F.max("n"), F.sum("n")).first()
            if (most or 0) <= HELD or now < turn / 4096:
                break
            now /= 4
        parts = 1 + 4 * (total or 0) // HELD
        small = few_checked(saved(sizes.where(F.col("n") <= HELD).select("comp", F.pmod(F.xxhash64("comp"), F.lit(parts)).alias("task")), "small"))
        mine = links.join(small, "comp").select("task", "src", "dst", "turn")
        theirs = own.join(small, "comp").select(F.col("task").alias("of"), "kind", "nid", "met")
        made.append(saved(mine.groupBy("task").cogroup(theirs.groupBy("of")).applyInArrow(_by_kinds, "src long, dst long, turn double"), "joined"))
        if (most or 0) > HELD:  # of one turn
            large = links.join(small, "comp", "left_anti")
            both = large.join(ends.select(F.col("kind").alias("src"), F.col("nid").alias("a"), "met"), "src").join(ends.select(F.col("kind").alias("dst"), F.col("nid").alias("b")), "dst")
            both = both.where("met <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "turn")
            made.append(saved(match_ends(both), "joined"))
        used = reduce(DataFrame.unionAll, (adjacency(m).select("nid") for m in made[-2 if (most or 0) > HELD else -1 :]))
        ends = saved(ends.join(used, "nid", "left_anti").select("kind", "nid", "met"), "ends_of", instead_of=ends)
        if now >= turn:
            return made, ends
        pairs = pairs.where(F.col("turn") > now)
        for c in ("src", "dst"):
            pairs = pairs.join(ends.select(F.col("kind").alias(c)).distinct(), c, "left_semi")
        pairs = saved(pairs.select("src", "dst", "turn"), "pairs")


def _by_kinds(pairs: pa.Table, ends: pa.Table) -> pa.Table:
    """``_in_order`` of the ends of whole components of kinds. Of two kinds that no other pair of the same turn touches, the
    lowest ends are joined, then the next."""
    kind, nid, met = (ends.column(c).to_numpy() for c in ("kind", "nid", "met"))
    order = np.lexsort((nid, kind))
    kind, nid, met = kind[order], nid[order], met[order]
    begin = np.flatnonzero(np.diff(kind, prepend=kind[:1] - 1)) if len(kind) else np.zeros(0, np.int64)
    free = dict(zip(kind[begin].tolist(), np.split(nid, begin[1:]), strict=True))
    barred = {(a, b) for a, b in zip(nid.tolist(), met.tolist(), strict=True) if a != b}
    of = dict(zip(nid.tolist(), kind.tolist(), strict=True)) if barred else {}
    apart = {(of[a], of[b]) for a, b in barred if b in of}
    src, dst, turn = (pairs.column(c).to_numpy() for c in ("src", "dst", "turn"))
    order = np.argsort(turn, kind="stable")
    src, dst, turn = src[order], dst[order], turn[order]
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in "qqd"]

    def put(a: np.ndarray, b: np.ndarray, t: float) -> None:
        for c, values in zip(out, (np.minimum(a, b), np.maximum(a, b), np.full(len(a), t)), strict=True):
            c.append(values)

    first = np.flatnonzero(np.diff(turn, prepend=-1.0))
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(turn)], strict=True):
        now = [(a, b) for a, b in zip(src[i:j].tolist(), dst[i:j].tolist(), strict=True) if len(free[a]) and len(free[b])]
        times = Counter(k for pair in now for k in pair)
        shared = []
        for a, b in now:
            if times[a] > 1 or times[b] > 1 or (a, b) in apart or (b, a) in apart:
                shared.append((a, b))
            else:
                n = min(len(free[a]), len(free[b]))
                put(free[a][:n], free[b][:n], turn[i])
                free[a], free[b] = free[a][n:], free[b][n:]
        if shared:
            made = _lowest_first(shared, free, barred)
            put(*np.array(made, np.int64).reshape(-1, 2).T, turn[i])
            used = {x for pair in made for x in pair}
            for k in {k for pair in shared for k in pair}:
                free[k] = np.array([x for x in free[k].tolist() if x not in used], np.int64)
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["src", "dst", "turn"])


def _lowest_first(pairs: list[tuple[int, int]], free: dict[int, np.ndarray], barred: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges made of one turn, in order of (src, dst), each end used once, without those ``barred``."""
    partners: dict[int, list[int]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append(b)
        partners.setdefault(b, []).append(a)
    lists, passed = {k: free[k].tolist() for k in partners}, dict.fromkeys(partners, 0)
    used: set[int] = set()
    made = []
    for x, kind in sorted((x, k) for k, xs in lists.items() for x in xs):
        if x in used:
            continue
        best = None
        for k in partners[kind]:
            xs, i = lists[k], passed[k]
            while i < len(xs) and (xs[i] < x or xs[i] in used):
                i += 1
            passed[k] = i
            while i < len(xs) and (xs[i] in used or (x, xs[i]) in barred or (xs[i], x) in barred):
                i += 1
            if i < len(xs) and (best is None or xs[i] < best):
                best = xs[i]
        if best is not None:
            used.update((x, best))
            made.append((x, best))
    return made


def _in_order(group: pd.DataFrame) -> pd.DataFrame:
    used: set[int] = set()
    made = []
    group = group.sort_values(["turn", "src", "dst"])
    for src, dst, turn in zip(*(group[c].tolist() for c in ("src", "dst", "turn")), strict=True):
        if src not in used and dst not in used:
            used.update((src, dst))
            made.append((src, dst, turn))
    return pd.DataFrame(made, columns=["src", "dst", "turn"])


def match_ends(candidates: DataFrame, together: int = TOGETHER) -> DataFrame:
    """The candidate edges that are made: taken in order of (turn, src, dst), each end used once.

    Up to ``together`` candidates are matched in that order in one task. Of more, rounds of pairs that are each other's
    best, which are in the matching whatever follows, are made first; then components of up to ``together`` are matched in
    tasks, as ends that compete, directly or through others, are a component of the candidates.
    """
    left, made = saved(candidates.where("src <> dst").select("src", "dst", "turn"), "candidates"), []
    match = "src long, dst long, turn double"
    while n := left.count():
        if n <= together:
            made.append(left.groupBy(F.lit(0).alias("task")).applyInPandas(_in_order, match))
            break
        key = F.struct("turn", "src", "dst")
        both = left.select(F.col("src").alias("nid"), key.alias("k")).unionAll(left.select("dst", key))
        best = both.groupBy("nid").agg(F.min("k").alias("k"))
        mutual = saved(best.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("k.src", "k.dst", "k.turn"), "mutual")
        used = adjacency(mutual).select("nid").distinct()
        rest = left.join(used.withColumnRenamed("nid", "src"), "src", "left_anti").join(used.withColumnRenamed("nid", "dst"), "dst", "left_anti")
        left = saved(rest.select("src", "dst", "turn"), "candidates", instead_of=left)
        made.append(mutual)
        if left.count() > max(together, n * SHRUNK):
            small, left = _by_tasks(left, left, together)
            made.append(small.groupBy("task").applyInPandas(_in_order, match))
            left = saved(left, "candidates")
    return reduce(DataFrame.unionAll, made) if made else left


def auto_connect(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` (src, dst, creator) after the repair of a graph: sharp bends are cut, in order of nid, then
    ends that face each other are joined by edges by 'connector', and both ends are flagged again (checked -1)."""
    cut = saved(remove_bends(edges, cut_in_order(saved(sharp_bends(nodes, edges), "bends"))), "cut")
    made = saved(joined_ends(nodes, cut), "made")
    new = made.select("src", "dst", F.lit("connector").alias("creator"))
    flags = adjacency(made).select("nid", F.lit(-1).alias("checked"))
    return patch(nodes, flags, "checked"), cut.select("src", "dst", "creator").unionByName(new)


def mean_step(track: pd.DataFrame) -> np.ndarray:
    """The default model: n x 3 displacements, each the mean step of a track towards its end at 16, 16, 16. Columns x0, y0,
    z0 are the track's farthest point."""
    return (16.0 - track[["x0", "y0", "z0"]].to_numpy(float)) / (track.attrs["points"] - 1)


#: Side of the crop that a model gets, its middle being the end.
CROP = 32


def next_points(
    nodes: DataFrame, edges: DataFrame, points: int = 5, model: Callable[[pd.DataFrame], np.ndarray] = mean_step, voxels: DataFrame | None = None, image: list[int] | None = None
) -> DataFrame:
    """(nid, x, y, z): a new point beyond each end whose walk has ``points`` nodes: where ``model`` moves it.

    The model gets tracks, some at a time: columns x0, y0, z0 of the farthest point to those of the end itself, moved so
    that the end is at 16 on each axis, the middle of a cube of 32. With ``voxels`` of an image (sizes ``image``) it gets one
    track at a time, with a column ``crop``: that cube of the image, 0 outside it.
    """
    tips = degree(nodes, edges).where("degree = 1")
    walks = walk_from_ends(tips, edges, points - 1)
    at = walks.join(nodes.select(F.col("nid").alias("at"), *(F.col(k).cast("double").alias(k) for k in AXES)), "at")
    whole = at.groupBy("nid").agg(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("step"), *AXES))).alias("p")).where(F.size("p") == points)
    end = F.col("p")[points - 1]
    tracks = whole.select("nid", *(end[k].alias("end_" + k) for k in AXES), *((F.col("p")[i][k] - end[k] + CROP // 2).alias(f"{k}{i}") for i in range(points) for k in AXES))

    def moved(b: pd.DataFrame) -> np.ndarray:
        b.attrs["points"] = points
        return np.round(b[[f"end_{k}" for k in AXES]].to_numpy(float) + model(b), 6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            to = moved(b)
            yield pd.DataFrame({"nid": b["nid"], **{k: to[:, i] for i, k in enumerate(AXES)}})

    if voxels is None:
        return tracks.mapInPandas(run, "nid long, x double, y double, z double")

    def one(row: pd.Series, cube: np.ndarray) -> tuple:
        track = pd.DataFrame([row.drop("track").to_dict() | row["track"]])
        track["crop"] = [cube]
        return (int(row["roi"]), *moved(track)[0])

    corners = tracks.select(F.col("nid").alias("roi"), *((F.floor("end_" + k) - CROP // 2).alias(k + "0") for k in AXES), F.struct(*tracks.columns).alias("track"))
    return with_crops(corners, voxels, CROP, image, one, "nid long, x double, y double, z double")


def extended(nodes: DataFrame, edges: DataFrame, found: DataFrame, creator: str = "extend") -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` with a new node and an edge to it for each row of ``found`` (nid, x, y, z); new nids follow
    the highest one in order of the ends. ``nodes`` has nid, x, y, z, creator, type and checked."""
    top = nodes.agg(F.coalesce(F.max("nid"), F.lit(0))).first()[0]
    made = saved(numbered(found.withColumnRenamed("nid", "of"), "nid", "of").withColumn("nid", F.col("nid") + top), "made")
    kinds = dict(nodes.dtypes)
    new = made.select("nid", *(F.col(k).cast(kinds[k]).alias(k) for k in AXES), F.lit(creator).alias("creator"), F.lit(0).alias("type"), F.lit(0).alias("checked"))
    return nodes.select(*new.columns).unionByName(new), edges.select("src", "dst", "creator").unionByName(made.select(F.col("of").alias("src"), F.col("nid").alias("dst"), F.lit(creator).alias("creator")))


def interpolated(nodes: DataFrame, edges: DataFrame, voxels: DataFrame, least: float = 6, most: float = 300) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` with every edge of ``least`` to ``most`` voxels that 'seger' has not made replaced by a
    chain along its brightest path: every third voxel becomes a node, and nodes and edges are by 'astar'.

    The two directions of an edge are one and go together; a way of two points leaves its edge as it is. New nids follow
    the highest one, in order of the edges and along them. ``nodes`` has nid, x, y, z, creator, type and checked.
    """
    manual = canonical(not_by(edges)).where("src < dst")
    long = ends(manual, nodes).where(norm(step("a", "b")).between(least, most))
    long = saved(numbered(long.select("src", "dst", *(p + k for p in "ab" for k in AXES)), "edge", "src", "dst"), "long")
    # edges between the same two places, in the same order, have one way
    at = [p + k for p in "ab" for k in AXES]
    alike = saved(long.groupBy(at).agg(F.min("edge").alias("edge")), "alike")
    ways = brightest_paths(alike, voxels).groupBy("edge").agg(F.sort_array(F.collect_list(F.struct("ord", *AXES))).alias("p"))
    ways = ways.select("edge", every_third(F.col("p")).alias("p")).where(F.size("p") > 2)
    ways = alike.join(ways, "edge").drop("edge")
    ways = saved(long.join(ways, at).select("edge", "src", "dst", "p"), "ways")
    inner = F.expr("slice(p, 2, size(p) - 2)")
    made = ways.select("edge", F.posexplode(inner).alias("i", "p")).select("edge", "i", *(F.col(f"p.{k}") for k in AXES))
    top = nodes.agg(F.coalesce(F.max("nid"), F.lit(0))).first()[0]
    made = saved(numbered(made, "nid", "edge", "i").withColumn("nid", F.col("nid") + top), "made")
    new = made.select("nid", *AXES, F.lit("astar").alias("creator"), F.lit(0).alias("type"), F.lit(0).alias("checked"))
    first = ways.select("edge", F.lit(-1).alias("i"), F.col("src").alias("nid"))
    last = ways.select("edge", F.size("p").alias("i"), F.col("dst").alias("nid"))
    steps = first.unionByName(made.select("edge", "i", "nid")).unionByName(last)
    steps = steps.select("edge", F.col("nid").alias("src"), F.lead("nid").over(W.partitionBy("edge").orderBy("i")).alias("dst"))
    steps = steps.where("dst is not null").select("src", "dst", F.lit("astar").alias("creator"))
    gone = ways.select("src", "dst").unionAll(ways.select("dst", "src"))
    kept = edges.where(F.coalesce(F.col("creator") == "seger", F.lit(True))).unionByName(not_by(edges).join(gone, ["src", "dst"], "left_anti").select(*edges.columns))
    return nodes.select(*new.columns).unionByName(new), kept.select(*steps.columns).unionByName(steps)
