"""Degrees, components, forests and trees of ``nodes`` (nid) and ``edges`` (src, dst).

Edges are undirected; ``canonical`` gives one row with src <= dst for each.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracegraph.operators import parts
from tracegraph.operators.components import MAX_ROUNDS, star_edges
from tracegraph.store import forget, saved


def canonical(edges: DataFrame) -> DataFrame:
    """One row (src <= dst) for each pair."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src is not null and dst is not null").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(nid, nbr), both directions; a self-loop gives two rows."""
    return edges.select(F.col("src").alias("nid"), F.col("dst").alias("nbr")).unionAll(edges.select("dst", "src"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with degree (a self-loop counts twice) and class: isolated, terminal, path or branch."""
    counts = adjacency(edges).groupBy("nid").agg(F.count(F.lit(1)).alias("degree"))
    out = nodes.join(counts, "nid", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    d = F.col("degree")
    return out.withColumn("class", F.when(d == 0, "isolated").when(d == 1, "terminal").when(d == 2, "path").otherwise("branch"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    ids = nodes.select("nid").distinct()
    out = edges.join(ids.withColumnRenamed("nid", "src"), "src", "left_semi").join(ids.withColumnRenamed("nid", "dst"), "dst", "left_semi")
    return out.select(*edges.columns)


def components(nodes: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``nodes`` with comp, the least nid of the component; a node without edges is its own. ``found``: what ``star_edges``
    gives for ``edges``, if it is there."""
    found = star_edges(edges) if found is None else found
    return nodes.join(found, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))


def _with_comp(edges: DataFrame, comp: DataFrame) -> DataFrame:
    return edges.join(comp.select(F.col("nid").alias("src"), "comp"), "src")


def by_component(edges: DataFrame, comp: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(comp, src, dst, edge), written: ``edges`` with edge 1 and ``nodes`` (nid), if there are any, as src with edge 0, all with
    their component in ``comp`` (nid, comp); what has none is left out."""
    rows = _with_comp(edges, comp).select("comp", "src", "dst", F.lit(1).cast("long").alias("edge"))
    if nodes is not None:
        of = _with_comp(nodes.select(F.col("nid").alias("src")), comp)
        rows = rows.unionByName(of.select("comp", "src", F.lit(None).cast("long").alias("dst"), F.lit(0).cast("long").alias("edge")))
    return saved(rows, "by_component")


def spanning_forest(edges: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """The edges that Kruskal's algorithm keeps in (src, dst) order. Canonical rows. Components (``comp``: nid, comp, if they
    are known) are solved in tasks, large ones by rounds."""
    whole = canonical(edges).where("src <> dst")
    if comp is None:
        whole = saved(whole, "whole")
        comp = star_edges(whole)
    rows = saved(_with_comp(whole, comp).select("comp", "src", "dst"), "left")
    small, large = parts.dealt(rows)
    out = parts.solved(small.select("src", "dst", "part"), parts.forest, "src long, dst long")
    if large is not None:
        out = out.unionByName(forest_by_rounds(rows.join(large, "comp", "left_semi")))
    return saved(out, "forest")


def forest_by_rounds(edges: DataFrame) -> DataFrame:
    """The forest of canonical ``edges`` by Borůvka's rounds: each component takes its least edge to another one."""
    left = saved(edges.select("src", "dst").withColumn("a", F.col("src")).withColumn("b", F.col("dst")), "left")
    chosen = None
    for _ in range(MAX_ROUNDS):
        ends = left.select(F.col("a").alias("c"), F.struct("src", "dst").alias("e")).unionAll(left.select("b", F.struct("src", "dst")))
        picked = ends.groupBy("c").agg(F.min("e").alias("e")).select("e.src", "e.dst").distinct()
        picked = saved(picked.join(left, ["src", "dst"]), "picked")
        if picked.isEmpty():
            break
        kept = picked.select("src", "dst")
        chosen = kept if chosen is None else chosen.unionAll(kept)
        merged = star_edges(picked.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        for k in ("a", "b"):
            new = merged.select(F.col("nid").alias(k), F.col("comp").alias("to"))
            left = left.join(new, k, "left").withColumn(k, F.coalesce("to", k)).drop("to")
        left = saved(left.where("a <> b").select("src", "dst", "a", "b"), "left")
    else:
        raise RuntimeError(f"the forest was not whole after {MAX_ROUNDS} rounds")
    return chosen if chosen is not None else left.select("src", "dst")


def rooted(forest: DataFrame, roots: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """(nid, parent) of every node of the trees that hold one of ``roots`` (nid); a root's parent is -1. Trees (``comp``:
    nid, comp, if they are known) are solved in tasks, large ones by their tours."""
    forest = forest.where("src <> dst").select("src", "dst")
    if comp is None:
        comp = star_edges(forest)
    rows = _with_comp(forest, comp).select("comp", "src", "dst", F.lit(1).cast("long").alias("edge"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    rows = rows.unionByName(_with_comp(roots.select(F.col("nid").alias("src")), comp).select("comp", "src", none.alias("dst"), zero.alias("edge")))
    rows = saved(rows, "trees")
    small, large = parts.dealt(rows)
    down = parts.solved(small.select("src", "dst", "edge", "part"), parts.parents, "nid long, parent long")
    if large is not None:
        # a tour without a root has no end
        large = large.join(rows.where("edge = 0"), "comp", "left_semi")
        rest = saved(rows.join(large, "comp", "left_semi"), "rest")
        down = down.unionByName(_down(rest.where("edge = 1"), rest.where("edge = 0").select(F.col("src").alias("nid"))))
    return down.unionAll(roots.select("nid", F.lit(-1).cast("long")))


def rooted_forest(edges: DataFrame, roots: DataFrame, comp: DataFrame) -> DataFrame:
    """``rooted`` of ``spanning_forest``, with one deal of the edges among tasks: (nid, parent) of the components (``comp``: nid,
    comp) that hold one of ``roots`` (nid)."""
    roots = saved(roots.select("nid"), "roots")
    rows = by_component(canonical(edges).where("src <> dst"), comp, roots)
    small, large = parts.dealt(rows)
    down = parts.solved(small.select("src", "dst", "edge", "part"), parts.rooted_forest, "nid long, parent long")
    if large is not None:
        rest = saved(rows.join(large, "comp", "left_semi"), "rest")
        at = rest.where("edge = 0")
        # a tour without a root has no end
        forest = forest_by_rounds(rest.where("edge = 1").join(at.select("comp"), "comp", "left_semi"))
        down = down.unionByName(_down(saved(forest, "forest"), at.select(F.col("src").alias("nid"))))
    return down.unionAll(roots.select("nid", F.lit(-1).cast("long")))


def _down(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """(nid, parent) of the nodes below ``roots``.

    The trees' Euler tours, cut at the roots, are ranked by pointer jumping: an edge is first walked away from the root.
    Rounds grow with the logarithm of a tree's size.
    """
    arcs = adjacency(forest.where("src <> dst")).select(F.col("nid").alias("u"), F.col("nbr").alias("v"))
    around = W.partitionBy("u").orderBy("v")
    turn = arcs.select(
        F.col("u"), F.col("v"), F.lead("v").over(around).alias("nxt"), F.first("v").over(around).alias("first")
    )
    ends = roots.select(F.col("nid").alias("u"), F.lit(True).alias("root"))
    # after arriving at u from v the tour leaves for the neighbour after v; at a root it ends after the last
    turn = turn.join(ends, "u", "left").select(
        F.col("v").alias("a"), F.col("u").alias("b"), F.when(F.col("nxt").isNotNull(), F.col("nxt")).when(F.col("root").isNull(), F.col("first")).alias("to")
    )
    state = saved(turn.select("a", "b", F.when(F.col("to").isNotNull(), F.col("b")).alias("na"), F.col("to").alias("nb"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("far")), "tour")
    for _ in range(MAX_ROUNDS):
        if state.where("nb is not null").isEmpty():
            break
        ahead = state.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("na2"), F.col("nb").alias("nb2"), F.col("far").alias("more"))
        state = saved(
            state.where("nb is null").unionByName(
                state.where("nb is not null").join(ahead, ["na", "nb"]).select("a", "b", F.col("na2").alias("na"), F.col("nb2").alias("nb"), (F.col("far") + F.col("more")).alias("far"))
            ),
            "tour",
            instead_of=state,
        )
    else:
        raise RuntimeError(f"tours were not ranked after {MAX_ROUNDS} rounds")
    back = state.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("far").alias("home"))
    return state.join(back, ["a", "b"]).where("far > home").select(F.col("b").alias("nid"), F.col("a").alias("parent"))


def _chains(arcs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, end, far, back): for each arc (nid, nbr, far, back) of ``arcs``, the first node with ``key`` that a walk along it
    meets, and what it costs to get there and back. ``own`` has a row (nid, key, lo, hi) for each node; one without key has
    two neighbours, lo and hi.

    Pointer jumping: rounds grow with the logarithm of the longest chain. Rings without a key node give no rows.
    """
    to = own.select(F.col("nid").alias("b"), "key", "lo", "hi")
    on = ~F.col("key")
    state = arcs.select(F.col("nid").alias("a"), F.col("nbr").alias("b"), "far", "back").join(to, "b")
    state = state.select(
        "a",
        "b",
        F.when(on, F.col("b")).alias("na"),
        F.when(on, F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))).alias("nb"),
        F.when(F.col("key"), F.col("b")).alias("end"),
        "far",
        "back",
    )
    state, before = saved(state, "chains"), None
    # as long as a walk has not met its end, one each round does; those left are rings
    while (left := state.where("na is not null").count()) and left != before:
        before = left
        ahead = state.select(
            F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("na2"), F.col("nb").alias("nb2"), F.col("end").alias("end2"), F.col("far").alias("more"), F.col("back").alias("more_back")
        )
        moved = state.where("na is not null").join(ahead, ["na", "nb"])
        moved = moved.select(
            "a", "b", F.col("na2").alias("na"), F.col("nb2").alias("nb"), F.col("end2").alias("end"), (F.col("far") + F.col("more")).alias("far"), (F.col("back") + F.col("more_back")).alias("back")
        )
        state = saved(state.where("na is null").unionByName(moved), "chains", instead_of=state)
    return state.where("end is not null").select("a", "end", "far", "back")


def _reduced(ways: DataFrame, first: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of ``ways`` (nid, nbr, cost) once no node but those of ``first`` (nid) has fewer than three neighbours,
    and the nodes taken out, in order: tables (nid, at, cost) of the nodes ``at`` that each is reached from.

    Rake and compress: leaves go, then each chain becomes one edge, until neither is there. Trees that hang on rings go in
    a number of rounds that grows with the logarithm of their size, as half of a chainless tree's nodes are leaves. Ways
    between the nodes left cost what they did.
    """
    begin = first.select("nid", F.lit(True).alias("begin"))
    both = ways.join(ways.select(F.col("nid").alias("nbr"), F.col("nbr").alias("nid"), F.col("cost").alias("back")), ["nid", "nbr"])
    arcs = saved(both.select("nid", "nbr", F.col("cost").alias("far"), "back"), "arcs")
    removed: list[DataFrame] = []

    def degrees() -> DataFrame:
        out = arcs.groupBy("nid").agg(F.count(F.lit(1)).alias("n"), F.min("nbr").alias("lo"), F.max("nbr").alias("hi"))
        return out.join(begin, "nid", "left")

    while True:
        leaves = saved(degrees().where("n = 1 and begin is null").select("nid"), "leaves")
        raked = not leaves.isEmpty()
        if raked:
            removed.append(saved(arcs.join(leaves, "nid", "left_semi").select("nid", F.col("nbr").alias("at"), F.col("back").alias("cost")), "raked"))
            rest = arcs.join(leaves, "nid", "left_anti").join(leaves.withColumnRenamed("nid", "nbr"), "nbr", "left_anti")
            arcs = saved(rest.select("nid", "nbr", "far", "back"), "arcs", instead_of=arcs)
        own = saved(degrees().select("nid", "lo", "hi", ((F.col("n") != 2) | F.col("begin").isNotNull()).alias("key")), "own")
        inner = own.where("not key").select(F.col("nid").alias("a"))
        compressed = not inner.isEmpty()
        if compressed:
            chains = _chains(arcs, own)
            removed.append(saved(chains.join(inner, "a", "left_semi").select(F.col("a").alias("nid"), F.col("end").alias("at"), F.col("back").alias("cost")), "compressed"))
            kept = chains.where("a <> end").join(own.where("key").select(F.col("nid").alias("a")), "a", "left_semi")
            kept = kept.groupBy(F.col("a").alias("nid"), F.col("end").alias("nbr")).agg(F.min("far").alias("far"), F.min("back").alias("back"))
            arcs = saved(kept, "arcs", instead_of=arcs)
        forget(leaves, own)
        if not raked and not compressed:
            return arcs.select("nid", "nbr", F.col("far").alias("cost")), removed


def tree_costs(ways: DataFrame, roots: DataFrame) -> DataFrame:
    """(nid, hops): the sum of the costs from ``roots`` (nid), one in each tree, to the nodes of the trees of ``ways`` (nid,
    nbr, cost), which have both directions of each edge. Rounds grow with the logarithm of a tree's size."""
    parents = _down(ways.where("nid < nbr").select(F.col("nid").alias("src"), F.col("nbr").alias("dst")), roots)
    step = ways.select(F.col("nid").alias("parent"), F.col("nbr").alias("nid"), "cost")
    state = parents.join(step, ["nid", "parent"]).select("nid", F.col("parent").alias("up"), F.col("cost").alias("hops"))
    top = roots.select("nid", F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("hops"))
    state = saved(state.unionByName(top), "depth")
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("nid").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("more"))
        moved = state.where("up is not null").join(above, "up").select("nid", F.col("up2").alias("up"), (F.col("hops") + F.col("more")).alias("hops"))
        state = saved(state.where("up is null").unionByName(moved), "depth", instead_of=state)
    return state.select("nid", "hops")


def hops(edges: DataFrame, start: DataFrame, nodes_cost: DataFrame | None = None, limit: int | None = None, comp: DataFrame | None = None) -> DataFrame:
    """(nid, hops): least number of edges from the nodes of ``start`` (nid).

    With ``nodes_cost`` (nid, cost of 0 or 1) a step costs what the node it leaves costs (nothing at a start). Components
    (``comp``: nid, comp, if they are known) are solved in tasks, large ones by rounds. Raises if a node is more than
    ``limit`` hops away.
    """
    pairs = canonical(edges).where("src <> dst")
    if comp is None:
        pairs = saved(pairs, "pairs")
        comp = star_edges(pairs)
    first = saved(start.select("nid").where("nid is not null").distinct(), "starts")
    at, none = first.select(F.col("nid").alias("src")), F.lit(None).cast("long")
    # components without a start take no part
    started = saved(_with_comp(at, comp).select("comp", "src", none.alias("dst"), F.lit(1).cast("long").alias("kind")), "started")
    own = saved(comp.select("nid", "comp").join(started.select("comp").distinct(), "comp", "left_semi"), "own")
    rows = _with_comp(pairs, own).select("comp", "src", "dst", F.lit(0).cast("long").alias("kind"))
    if nodes_cost is not None:
        price = nodes_cost.groupBy(F.col("nid").alias("src")).agg(F.coalesce(F.min("cost"), F.lit(0)).cast("long").alias("dst")).where("dst <> 0")
        rows = rows.unionByName(_with_comp(price, own).select("comp", "src", "dst", F.lit(2).cast("long").alias("kind")))
    rows = saved(rows.unionByName(started), "hops")
    small, large = parts.dealt(rows)
    found = parts.solved(small.select("src", "dst", "kind", "part"), partial(parts.costs, priced=nodes_cost is not None), "nid long, hops long")
    if large is not None:
        rest = saved(rows.join(large, "comp", "left_semi"), "rest")
        price = None if nodes_cost is None else rest.where("kind = 2").select(F.col("src").alias("nid"), F.col("dst").alias("cost"))
        found = found.unionByName(_hops_by_rounds(rest.where("kind = 0"), rest.where("kind = 1").select(F.col("src").alias("nid")), price))
    # a start without edges is one all the same
    lone = first.join(rows.where("kind = 1").select(F.col("src").alias("nid")), "nid", "left_anti")
    out = found.unionByName(lone.select("nid", F.lit(0).cast("long").alias("hops")))
    if limit is not None:
        out = saved(out, "reached")
        if not out.where(F.col("hops") > limit).isEmpty():
            raise RuntimeError(f"there are nodes more than {limit} hops away")
    return out


def _hops_by_rounds(edges: DataFrame, start: DataFrame, nodes_cost: DataFrame | None) -> DataFrame:
    """``hops`` of large components. Chains of nodes that no way forks, starts or costs at become one edge first. Components that are then trees with one
    start are solved by their tours and by doubling the way to the root, in a number of rounds that grows with its
    logarithm. From others the trees that hang on rings are taken out by rake and compress, and a frontier moves over
    what is left, chain by chain: rounds grow with the forks on a way that are forks of rings or ways between starts.
    """
    adj = saved(adjacency(edges).where("nid <> nbr").distinct(), "adjacency")
    first = start.select("nid").where("nid is not null").distinct()
    own = adj.groupBy("nid").agg(F.count(F.lit(1)).alias("n"), F.min("nbr").alias("lo"), F.max("nbr").alias("hi"))
    own = own.join(first.withColumn("begin", F.lit(True)), "nid", "left")
    if nodes_cost is None:
        own = own.withColumn("cost", F.lit(0).cast("long"))
    else:
        own = own.join(nodes_cost.groupBy("nid").agg(F.min("cost").cast("long").alias("cost")), "nid", "left")
    cost = F.when(F.col("begin").isNull(), F.coalesce("cost", F.lit(0))).otherwise(0).cast("long")
    own = own.withColumn("cost", cost)
    own = saved(own.select("nid", "lo", "hi", "cost", ((F.col("n") != 2) | F.col("begin").isNotNull() | (F.col("cost") != 0)).alias("key")), "ends")
    one = F.lit(1).cast("long")
    chains = _chains(adj.select("nid", "nbr", one.alias("far"), one.alias("back")), own)

    leaving = own.where("key").select(F.col("nid").alias("a"), "cost")
    price = F.col("far") if nodes_cost is None else F.col("cost")
    ways = chains.where("a <> end").join(leaving, "a").groupBy(F.col("a").alias("nid"), F.col("end").alias("nbr")).agg(F.min(price).alias("cost"))
    ways = saved(ways, "ways")
    comp = star_edges(ways, "nid", "nbr")  # of a written table
    size = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes"))
    size = size.join(ways.join(comp, "nid").groupBy("comp").agg((F.count(F.lit(1)) / 2).alias("edges")), "comp")
    size = size.join(first.join(comp, "nid").groupBy("comp").agg(F.count(F.lit(1)).alias("starts")), "comp")
    # of the components that have a start
    started = saved(comp.join(size.select("comp", (F.expr("edges = nodes - 1") & (F.col("starts") == 1)).alias("tree")), "comp").select("nid", "tree"), "started")
    trees, others = (started.where(F.col("tree") == x).select("nid") for x in (True, False))
    solved, removed = None, []
    if not trees.isEmpty():
        solved = tree_costs(ways.join(trees, "nid", "left_semi"), first.join(trees, "nid", "left_semi"))
        first = first.join(trees, "nid", "left_anti")
    ways = ways.join(others, "nid", "left_semi")
    if not others.isEmpty():
        ways, removed = _reduced(ways, first)
    done = front = first.withColumn("hops", F.lit(0).cast("long"))
    while True:
        reached = front.join(ways, "nid").groupBy(F.col("nbr").alias("nid")).agg(F.min(F.col("hops") + F.col("cost")).alias("hops"))
        better = reached.join(done.select("nid", F.col("hops").alias("had")), "nid", "left").where("had is null or hops < had").select("nid", "hops")
        front = saved(better, "front")
        if front.isEmpty():
            break
        new = done.join(front.select("nid", F.col("hops").alias("new")), "nid", "full").select("nid", F.coalesce("new", "hops").alias("hops"))
        done = saved(new, "reached", instead_of=done)
    for gone in reversed(removed):
        back = gone.join(done.withColumnRenamed("nid", "at"), "at").groupBy("nid").agg(F.min(F.col("hops") + F.col("cost")).alias("hops"))
        done = saved(done.unionByName(back), "reached", instead_of=done)
        forget(gone)
    if solved is not None:
        done = done.unionByName(solved)

    at = done.select(F.col("nid").alias("end"), "hops")
    inside = chains.join(own.where("not key").select(F.col("nid").alias("a")), "a", "left_semi").join(at, "end")
    inside = inside.join(leaving.withColumnRenamed("a", "end"), "end")
    return done.unionByName(inside.groupBy(F.col("a").alias("nid")).agg(F.min(F.col("hops") + price).alias("hops")))


def update_components(comp: DataFrame, edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """(nid, comp) after an edit: ``comp`` was right before it, ``edges`` (src, dst) are those after it; ``added`` and
    ``removed`` (src, dst) are edges and ``gone`` (nid) nodes that came or went. A node of ``added`` may be new.

    Only components with an end of such an edge, or such a node, are worked out again; all others keep their rows as they
    are and take no part in any round."""
    ids = [x for e in (added, removed) if e is not None for x in (e.select(F.col("src").alias("nid")), e.select(F.col("dst").alias("nid")))]
    ids += [gone.select("nid")] if gone is not None else []
    if not ids:
        return comp
    named = ids[0]
    for x in ids[1:]:
        named = named.unionAll(x)
    named = saved(named.where("nid is not null").distinct(), "named")
    touched = saved(comp.join(named, "nid", "left_semi").select("comp").distinct(), "touched")
    few = F.broadcast(touched) if touched.count() <= 1_000_000 else touched
    nodes = comp.join(few, "comp", "left_semi").select("nid")
    if added is not None:
        nodes = nodes.unionAll(adjacency(added).select("nid")).distinct()
    if gone is not None:
        nodes = nodes.join(gone.select("nid"), "nid", "left_anti")
    nodes = saved(nodes, "again")
    again = components(nodes, saved(induced(nodes, edges.select("src", "dst")), "again_edges"))
    return comp.join(few, "comp", "left_anti").select("nid", "comp").unionByName(again.select("nid", "comp"))
