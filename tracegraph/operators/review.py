"""Review queues and reports over components. ``nodes`` have comp, degree and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.functions.geometry import AXES, step
from tracegraph.operators.graph import components, degree, induced
from tracegraph.operators.grid import ends
from tracegraph.operators.repair import edge_lengths
from tracegraph.store import saved


def with_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with degree, class and comp, written down: most of what follows reads it more than once."""
    return saved(components(degree(nodes, edges), edges), "graph")


def pending() -> Column:
    return (F.col("checked") == -1) | ((F.col("degree") == 1) & (F.col("checked") == 0))


def meter(nodes: DataFrame) -> DataFrame:
    """(comp, size, pending) of every component."""
    return nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.count_if(pending()).alias("pending"))


def next_task(nodes: DataFrame) -> DataFrame:
    """(comp, size, nid): the largest component with something pending, the least of equals, and its least pending node."""
    top = meter(nodes).where("pending > 0").orderBy(F.desc("size"), "comp").limit(1)
    return nodes.where(pending()).join(top, "comp").groupBy("comp", "size").agg(F.min("nid").alias("nid"))


def annotation_info(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """(comp, size, ends, branches, length): components of ``least`` nodes or more with nothing pending; length is the
    whole part of their edges' total. Longest first."""
    per = nodes.groupBy("comp").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("degree") == 1).alias("ends"), F.count_if(F.col("degree") >= 3).alias("branches"), F.count_if(pending()).alias("pending")
    )
    lengths = edge_lengths(edges, nodes).join(nodes.select(F.col("nid").alias("src"), "comp"), "src").groupBy("comp").agg(F.sum("length").alias("length"))
    out = per.where((F.col("pending") == 0) & (F.col("size") >= least)).join(lengths, "comp", "left")
    out = out.select("comp", "size", "ends", "branches", F.coalesce(F.floor(F.round("length", 3)), F.lit(0)).cast("long").alias("length"))
    return out.orderBy(F.desc("length"), "comp")


def annotation_members(nodes: DataFrame, least: int = 1) -> DataFrame:
    """(comp, nid, role): the nodes of the components of ``annotation_info``, a row each; role is branch, end or node."""
    per = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.count_if(pending()).alias("pending"))
    done = per.where((F.col("pending") == 0) & (F.col("size") >= least)).select("comp")
    d = F.col("degree")
    return nodes.join(done, "comp", "left_semi").select("comp", "nid", F.when(d >= 3, "branch").when(d == 1, "end").otherwise("node").alias("role"))


def by_size(nodes: DataFrame, more_than: int = 10, limit: int = 20, long: bool = True) -> DataFrame:
    """Nodes of components of more than ``more_than``, and of those with ``limit`` nodes or more (or, if not ``long``, fewer)."""
    sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > more_than)
    return nodes.join(sizes.where(F.col("size") >= limit if long else F.col("size") < limit), "comp")


def purge(nodes: DataFrame, edges: DataFrame, centre: int, low: list[int], size: list[int], most: int = 4) -> DataFrame:
    """(nid) of small fragments: components of the block's own subgraph with at most ``most`` nodes and without the centre.
    The block grows by 10 below and 20 above, and a node on its border is in it."""
    for k, o, s in zip(AXES, low, size, strict=True):
        nodes = nodes.where((F.col(k) >= o - 10) & (F.col(k) <= o + s + 20))
    block = saved(components(nodes.select("nid"), induced(nodes.select("nid"), edges)), "block")
    small = block.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("nid") == centre).alias("own")).where((F.col("n") <= most) & ~F.col("own"))
    return block.join(small, "comp", "left_semi").select("nid")


def local_view(nodes: DataFrame, edges: DataFrame, centre: int, half: int) -> DataFrame:
    """(nid, comp, marker) of the closed cube around a node: components of the block's own subgraph; marker tells the
    centre, somas and the rest apart."""
    at = nodes.where(F.col("nid") == centre).select(*(F.col(k).alias("c" + k) for k in AXES))
    near = nodes.crossJoin(F.broadcast(at)).where(" and ".join(f"abs({k} - c{k}) <= {half}" for k in AXES))  # at: one row
    near = saved(near.select("nid", "type"), "near")
    out = components(near, induced(near.select("nid"), edges))
    return out.select("nid", "comp", F.when(F.col("nid") == centre, "centre").when(F.col("type") == 1, "soma").otherwise("node").alias("marker"))


def local_edges(nodes: DataFrame, edges: DataFrame, centre: int, half: int) -> DataFrame:
    """(src, dst, dx, dy, dz): the edges with an end in the closed cube around a node, as vectors."""
    near = local_view(nodes, edges, centre, half).select("nid")
    seen = edges.join(near.withColumnRenamed("nid", "src"), "src", "left_semi").unionByName(edges.join(near.withColumnRenamed("nid", "dst"), "dst", "left_semi").select(*edges.columns))
    both = ends(seen.select("src", "dst").distinct(), nodes)
    return both.select("src", "dst", *(v.cast("long").alias("d" + k) for v, k in zip(step("a", "b"), AXES, strict=True)))


def overview(nodes: DataFrame, edges: DataFrame, more_than: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes of components of more than ``more_than`` nodes, and the edges whose ends are both among them."""
    kept = by_size(nodes, more_than, 0)
    return kept, dangling(kept, edges)


def contrast(nodes: DataFrame, voxels: DataFrame) -> DataFrame:
    """(lo, hi): the contrast window of the voxels (x, y, z, v) at nodes."""
    v = nodes.select(*(F.col(k).cast("int").alias(k) for k in AXES)).join(voxels, list(AXES))
    got = v.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev"))
    return got.select(F.least(F.floor(F.col("mean") / 2), F.lit(200)).cast("long").alias("lo"), F.round(F.col("mean") + F.col("dev"), 4).alias("hi"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` without those that have an end in no node."""
    return induced(nodes, edges)
