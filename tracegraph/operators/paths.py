"""Chains of a graph: extraction in order, walks from ends, and what is made of them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.functions.geometry import AXES
from tracegraph.operators import parts
from tracegraph.operators.components import MAX_ROUNDS, star_edges
from tracegraph.operators.graph import adjacency, by_component, canonical, degree, forest_by_rounds, induced
from tracegraph.store import saved

CHAINS = "comp long, ord long, nid long"


def paths(nodes: DataFrame | None, edges: DataFrame, longer_than: int = 0, branches: bool = False) -> DataFrame:
    """(comp, ord, nid): what is left without nodes of degree 3 or more, where it has exactly two ends, in order from the
    end of lower nid; only chains of more than ``longer_than`` nodes. Rings and lone nodes vanish. Without ``nodes`` the ends
    of ``edges`` are the nodes. With ``branches``, as ``attach_branches`` gives them.

    Components are solved in tasks; of large ones the chains, or, of long chains, the order by pointer jumping.
    """
    edges = saved(canonical(edges), "pairs")
    rows = by_component(edges, star_edges(edges), nodes if nodes is None else nodes.select("nid"))
    small, large = parts.dealt(rows)
    solve = partial(parts.chains, longer_than=longer_than, given=nodes is not None, branches=branches)
    out = parts.solved(small.select("src", "dst", "edge", "part"), solve, CHAINS)
    if large is not None:
        rest = saved(rows.join(large, "comp", "left_semi"), "rest")
        left, own = _taken_apart(rest, nodes is not None)
        chains = _chains_of(left.select("nid"), own, longer_than)
        out = out.unionByName(attach_branches(saved(chains, "chains"), own) if branches else chains)
    return out


def _taken_apart(rows: DataFrame, given: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes (comp, nid) and edges (src, dst) of rows that ``by_component`` made; if no nodes were ``given``, the ends."""
    own = rows.where("edge = 1").select("src", "dst")
    if given:
        return rows.where("edge = 0").select("comp", F.col("src").alias("nid")), own
    ends = rows.where("edge = 1")
    return ends.select("comp", F.col("src").alias("nid")).union(ends.select("comp", "dst")).distinct(), own


def _chains_of(nodes: DataFrame, edges: DataFrame, longer_than: int) -> DataFrame:
    """``paths`` of large components: chains have components of their own once the branches are out."""
    plain = saved(degree(nodes, edges).where("degree < 3").select("nid"), "plain")
    inner = saved(induced(plain, edges).where("src <> dst"), "inner")
    rows = by_component(inner, star_edges(inner))
    small, large = parts.dealt(rows)
    out = parts.solved(small.select("src", "dst", "edge", "part"), partial(parts.chains, longer_than=longer_than), CHAINS)
    if large is not None:
        out = out.unionByName(_in_order(rows.join(large, "comp", "left_semi"), longer_than))
    return out


def _in_order(inner: DataFrame, longer_than: int) -> DataFrame:
    """(comp, ord, nid) of the edges (comp, src, dst) of long chains. Directed edges of a chain point to the one before;
    pointer jumping doubles the distance each round."""
    arcs = saved(inner.select("comp", F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(inner.select("comp", "dst", "src")), "arcs")
    ends = arcs.groupBy("comp", "u").agg(F.count(F.lit(1)).alias("degree")).groupBy("comp")
    ends = ends.agg(F.count_if(F.col("degree") == 1).alias("ends"), F.min(F.when(F.col("degree") == 1, F.col("u"))).alias("start"), F.count(F.lit(1)).alias("size"))
    good = saved(ends.where((F.col("ends") == 2) & (F.col("size") > longer_than)).select("comp", "start"), "good")
    arcs = saved(arcs.join(good.select("comp"), "comp", "left_semi"), "arcs", instead_of=arcs)
    before = arcs.select(F.col("u").alias("pu"), F.col("v").alias("pv"))
    state = arcs.join(before, (F.col("pv") == F.col("u")) & (F.col("pu") != F.col("v")), "left")
    state = saved(state.select("comp", "u", "v", "pu", "pv", F.when(F.col("pu").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("u").alias("first")), "rank")
    for _ in range(MAX_ROUNDS):
        if state.where("pu is not null").isEmpty():
            break
        back = state.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("pu2"), F.col("pv").alias("pv2"), F.col("dist").alias("more"), F.col("first").alias("first2"))
        # arcs that have met their chain's end are done; the others move on
        moved = state.where("pu is not null").join(back, ["pu", "pv"]).select(
            "comp", "u", "v", F.col("pu2").alias("pu"), F.col("pv2").alias("pv"), (F.col("dist") + F.col("more")).alias("dist"), F.col("first2").alias("first")
        )
        state = saved(state.where("pu is null").unionByName(moved), "rank", instead_of=state)
    else:
        raise RuntimeError(f"chains were not ranked after {MAX_ROUNDS} rounds")
    walked = state.join(good, "comp").where("first = start").select("comp", (F.col("dist") + 1).alias("ord"), F.col("v").alias("nid"))
    return good.select("comp", F.lit(0).cast("long").alias("ord"), F.col("start").alias("nid")).unionAll(walked)


def paths_by(nodes: DataFrame | None, edges: DataFrame, creator: str, longer_than: int = 0) -> DataFrame:
    """``paths`` of the graph that the edges of one creator make alone: what forks only by others' edges is no branch."""
    return paths(nodes, edges.where(F.col("creator") == creator).select("src", "dst"), longer_than)


def chain_counts(points: DataFrame, chain: str) -> DataFrame:
    """One row (chains, points, total): how many chains have two points or more, how many have one, and all points. A row
    of ``points`` is a point of the chain in the column ``chain``."""
    sizes = points.groupBy(chain).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.count_if(F.col("_n") >= 2).alias("chains"), F.count_if(F.col("_n") == 1).alias("points"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))


def walk_from_ends(ends: DataFrame, edges: DataFrame, steps: int = 5) -> DataFrame:
    """(nid, step, at): nodes met from each end (nid) along a chain, itself at step 0, at most ``steps`` edges far; a walk
    stops where the way forks or ends."""
    adj = adjacency(edges).where("nid <> nbr").distinct()
    only = adj.groupBy("nid").agg(F.count(F.lit(1)).alias("n"))
    adj = saved(adj.join(only, "nid"), "adjacency")
    now = ends.select("nid", F.col("nid").alias("at"), F.lit(None).cast("long").alias("prev"))
    out = now.select("nid", F.lit(0).cast("long").alias("step"), "at")
    for k in range(1, steps + 1):
        go = adj.select(F.col("nid").alias("at"), F.col("nbr").alias("next"), "n")
        now = now.join(go, "at").where(F.when(F.col("prev").isNull(), F.col("n") == 1).otherwise((F.col("n") == 2) & (F.col("next") != F.col("prev"))))
        now = now.select("nid", F.col("next").alias("at"), F.col("at").alias("prev"))
        out = out.unionAll(now.select("nid", F.lit(k).cast("long").alias("step"), "at"))
    return out


def segments_within(nodes: DataFrame, edges: DataFrame, voxels: DataFrame, origin: list[int], size: list[int], least: int = 0) -> DataFrame:
    """(comp, ord, nid, x, y, z, v): the chains of the subgraph inside a closed box (origin to origin + size), of ``least``
    nodes or more, with coordinates from the box's origin and the value of the voxel at each point."""
    for k, o, n in zip(AXES, origin, size, strict=True):
        nodes = nodes.where((F.col(k) >= o) & (F.col(k) <= o + n))
    inside = saved(nodes.select("nid", *AXES), "inside")
    chains = paths(inside, induced(inside, edges), least - 1)
    moved = chains.join(inside, "nid")
    at = moved.select("*", *(F.col(k).cast("int").alias("v" + k) for k in AXES))
    found = voxels.select(*(F.col(k).alias("v" + k) for k in AXES), "v")
    out = at.join(found, ["vx", "vy", "vz"], "left")
    return out.select("comp", "ord", "nid", *((F.col(k) - o).alias(k) for k, o in zip(AXES, origin, strict=True)), F.coalesce("v", F.lit(0)).alias("v"))


def coloured_paths(nodes: DataFrame | None, edges: DataFrame, more_than: int = 10, longer_than: int = 1) -> DataFrame:
    """(comp, ord, nid): the chains, with branch nodes put back at their ends, of a spanning forest of the components of
    more than ``more_than`` nodes. Without ``nodes`` the ends of ``edges`` are the nodes. Components are solved in tasks, large
    ones by rounds."""
    edges = saved(canonical(edges).where("src <> dst"), "pairs")
    rows = by_component(edges, star_edges(edges), nodes if nodes is None else nodes.select("nid"))
    small, large = parts.dealt(rows)
    solve = partial(parts.coloured, more_than=more_than, longer_than=longer_than, given=nodes is not None)
    out = parts.solved(small.select("src", "dst", "edge", "part"), solve, CHAINS)
    if large is not None:
        rest = saved(rows.join(large, "comp", "left_semi"), "rest")
        left, own = _taken_apart(rest, nodes is not None)
        full = left.join(left.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than), "comp", "left_semi").select("nid")
        full = saved(full, "full")
        own = saved(induced(full, forest_by_rounds(own)), "own")
        out = out.unionByName(attach_branches(saved(_chains_of(full, own, longer_than), "chains"), own))
    return out


def attach_branches(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """(comp, ord, nid): chains with the branch node put before or after an end that has exactly one neighbour outside."""
    last = chains.groupBy("comp").agg(F.max("ord").alias("last"))
    tips = chains.join(last, "comp").where("ord = 0 or ord = last")
    outside = tips.join(adjacency(edges).distinct(), "nid").join(chains.select("comp", F.col("nid").alias("nbr"), F.lit(True).alias("own")), ["comp", "nbr"], "left").where("own is null")
    outside = outside.groupBy("comp", "ord").agg(F.count(F.lit(1)).alias("n"), F.min("nbr").alias("nid"), F.max("last").alias("last")).where("n = 1")
    extra = outside.select("comp", F.when(F.col("ord") == 0, F.lit(-1)).otherwise(F.col("last") + 1).cast("long").alias("ord"), "nid")
    return chains.select("comp", "ord", "nid").unionAll(extra)
