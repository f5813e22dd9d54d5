"""Boxes, tiles and range joins on a grid of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracegraph.functions.geometry import AXES, norm, step
from tracegraph.operators import blocks, octree
from tracegraph.operators.graph import adjacency
from tracegraph.store import saved, tasks


def _spread(df: DataFrame, half: float, size: float) -> DataFrame:
    """Each row once for every cell that its box touches."""
    wide = half * 1.0001
    for k in AXES:
        lo, hi = (F.floor((F.col(k) + d) / size) for d in (-wide, wide))
        df = df.withColumn("c" + k, F.explode(F.sequence(lo, hi)))
    return df


def _pairs(a: DataFrame, b: DataFrame, half: float, capacity: int, k: int | None = None) -> DataFrame:
    """(nid, x, y, z, comp, m, mx, my, mz, mcomp): pairs of different nodes within ``half`` on every axis; with ``k``, (nid,
    m, dist) of those that can be among the k nearest of another component, at least.

    Each row of ``a`` goes to the cells that its box touches, so that an equi-join on cells finds every pair once; what
    lies in crowded cells, or next to them, goes by the leaves of octrees. Where few pairs are kept, cells are as wide as
    the box, and blocks of them are searched whole (see ``blocks``).
    """
    near = F.col("nid") != F.col("m")
    for c in AXES:
        near = near & (F.abs(F.col(c) - F.col("m" + c)) <= half)
    size = float(max(half, 1)) if k is None else 2.001 * (half or 1)
    a, b = octree.placed(a, size), octree.placed(b, size)
    crowded = octree.crowded_cells(a, b, capacity)
    far = None
    if not crowded.isEmpty():
        far = octree.crowded_pairs(a, b, crowded, half, capacity, k)
        far = far.where(near)
        a, b = (p.join(crowded, octree.CELL, "left_anti") for p in (a, b))
    if k is not None:
        pairs = blocks.k_nearest(a, b, half, k)
        return pairs if far is None else pairs.unionByName(far.where("comp <> mcomp").select("nid", "m", F.round(norm(step("", "m")), 6).alias("dist")))
    other = b.select(F.col("nid").alias("m"), *(F.col(c).alias("m" + c) for c in (*AXES, "comp")), *octree.CELL)
    # few bytes, much work: dealt out among tasks
    n = tasks(a.sparkSession)
    pairs = _spread(a.drop(*octree.FINE), half, size).repartition(n, *octree.CELL).join(other.repartition(n, *octree.CELL), octree.CELL).drop(*octree.CELL)
    pairs = pairs.where(near)
    return pairs if far is None else pairs.unionByName(far)


def _points(df: DataFrame, comp: Column) -> DataFrame:
    return df.select("nid", *(F.col(k).cast("double") for k in AXES), comp.alias("comp"))


def box_pairs(centres: DataFrame, nodes: DataFrame, half: float, capacity: int = octree.CAPACITY) -> DataFrame:
    """All nodes within ``half`` of each centre on every axis, the centre itself left out: (nid, x, y, z) against (m, mx,
    my, mz). A cell of more than ``capacity`` nodes or centres is split (see ``octree``)."""
    none = F.lit(None).cast("long")
    return _pairs(_points(centres, none), _points(nodes, none), half, capacity).drop("comp", "mcomp")


#: Nodes in a centre's box, on average, up to which it is searched at once.
CROWD = 64


def _first_reach(nodes: DataFrame, half: float) -> float:
    """``half`` or, where a node's box holds more than CROWD nodes on average, a half, a quarter and so on of it."""
    cells = nodes.groupBy(*(F.floor(F.col(k) / (half or 1)) for k in AXES)).agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = 8 * (cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0)
    reach = float(half)
    for _ in range(10):
        if held <= CROWD:
            break
        reach, held = reach / 2, held / 8
    return reach


def _k_best(centres: DataFrame, nodes: DataFrame, half: float, k: int, capacity: int) -> DataFrame:
    pairs = _pairs(centres, nodes, half, capacity, k)
    of = W.partitionBy("nid")
    # a task leaves all but its own k best of a centre before rows are dealt by centre
    best = pairs.withColumn("rank", F.row_number().over(of.orderBy("dist", "m"))).where(F.col("rank") <= k)
    if k > 1:
        best = best.withColumn("n", F.max("rank").over(of)).where(F.col("n") == k)
    return best.select("nid", "m", "dist", F.col("rank").cast("long"))


def nearest_foreign(centres: DataFrame, nodes: DataFrame, half: float, k: int = 1, capacity: int = octree.CAPACITY) -> DataFrame:
    """(nid, m, dist, rank): the k nearest nodes of other components in each centre's box, ties by nid; nothing for a
    centre with fewer than k. Both inputs have comp. In cells of more than ``capacity`` nodes or centres, only pairs of
    leaves that may hold one of the k are compared (see ``octree``).

    Where boxes hold many nodes, smaller boxes are searched first: a centre with k nodes of other components no farther
    than a smaller box reaches is done, as all nodes outside are farther; the others go on with one twice as wide.
    """
    a, b = _points(centres, F.col("comp")), _points(nodes, F.col("comp"))
    reach, found = _first_reach(b, half), []
    if reach < half:
        a, b = saved(a, "centres"), saved(b, "nodes")
    while reach < half:
        # a little wider, so that no distance outside is rounded to one inside
        best = saved(_k_best(a, b, reach * 1.001, k, capacity), "nearest")
        done = best.where((F.col("rank") == k) & (F.col("dist") <= reach)).select("nid")
        found.append(best.join(done, "nid", "left_semi"))
        a = saved(a.join(done, "nid", "left_anti"), "centres", instead_of=a)
        reach *= 2
    out = _k_best(a, b, half, k, capacity)
    for best in found:
        out = out.unionByName(best)
    return out


def uncheck_junctions(nodes: DataFrame, edges: DataFrame, half: float = 6, more_than: int = 10) -> DataFrame:
    """(nid): nodes to flag as unseen. ``nodes`` have comp, degree and checked; for every unseen terminal of a component
    of more than ``more_than`` nodes, the nearest foreign node, if it is a path node."""
    sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    ends = nodes.where("degree = 1 and checked = 0").join(sizes.where(F.col("size") > more_than), "comp", "left_semi")
    found = nearest_foreign(ends, nodes, half)
    return found.select(F.col("m").alias("nid")).join(nodes.where("degree = 2").select("nid"), "nid", "left_semi").distinct()


def tiles(rois: DataFrame, size: int, whole_only: bool = False) -> DataFrame:
    """Tiles of each roi (roi, x0, y0, z0, sx, sy, sz): a ceil grid whose last tiles are clipped, or complete tiles only."""
    for k in AXES:
        n = (F.floor if whole_only else F.ceil)(F.col(f"s{k}") / size)
        rois = rois.withColumn(f"t{k}", F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1))))
    return rois.select(
        "roi",
        *((F.col(f"{k}0") + F.col(f"t{k}") * size).cast("long").alias(f"{k}0") for k in AXES),
        *(F.least(F.lit(size), F.col(f"s{k}") - F.col(f"t{k}") * size).cast("long").alias(f"s{k}") for k in AXES),
    )


def sliding(rois: DataFrame, size: int, overlap: int) -> DataFrame:
    """Complete tiles at a step of size - overlap."""
    pace = size - overlap
    for k in AXES:
        last = F.floor((F.col(f"s{k}") - size) / pace).cast("int")
        rois = rois.withColumn(f"t{k}", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    return rois.select("roi", *((F.col(f"{k}0") + F.col(f"t{k}") * pace).cast("long").alias(f"{k}0") for k in AXES), *(F.lit(size).cast("long").alias(f"s{k}") for k in AXES))


def spliced(rois: DataFrame, size: int, splices: int) -> DataFrame:
    """Tiles of each roi, cut in z at its own start and, where ``size`` is a multiple of ``splices``, at the multiples of
    ``splices`` inside it, else each ``size`` from its start; x and y as in ``tiles``."""
    z0 = F.col("z0").cast("long")
    end = z0 + F.col("sz").cast("long")
    pace = F.lit(splices if size % splices == 0 else size).cast("long")
    first = F.floor(z0 / splices) * splices + splices if size % splices == 0 else z0 + size
    inner = F.when(first < end, F.sequence(first.cast("long"), end - 1, pace)).otherwise(F.array().cast("array<long>"))
    rois = rois.where("sx > 0 and sy > 0 and sz > 0").withColumn("cuts", F.concat(F.array(z0), inner, F.array(end)))
    rois = rois.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)))
    rois = rois.withColumns({"za": F.get("cuts", F.col("i")), "zb": F.get("cuts", F.col("i") + 1)})
    for k in "xy":
        rois = rois.withColumn(f"t{k}", F.explode(F.sequence(F.lit(0), F.ceil(F.col(f"s{k}") / size).cast("int") - 1)))
    return rois.select(
        "roi",
        *((F.col(f"{k}0") + F.col(f"t{k}") * size).cast("long").alias(f"{k}0") for k in "xy"),
        F.col("za").alias("z0"),
        *(F.least(F.lit(size), F.col(f"s{k}") - F.col(f"t{k}") * size).cast("long").alias(f"s{k}") for k in "xy"),
        (F.col("zb") - F.col("za")).alias("sz"),
    )


def haloed(voxels: DataFrame, size: int, halo: int = 4) -> DataFrame:
    """``voxels`` once for every tile whose box, widened by ``halo``, holds them; core tells its own tile's rows. Tiles
    begin at 0; a tile number below 0 holds no core rows and is left out. Needs halo <= size."""
    for k in AXES:
        lo, hi = F.floor((F.col(k) - halo) / size), F.floor((F.col(k) + halo) / size)
        voxels = voxels.withColumn(f"t{k}", F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("long"), hi.cast("long"))))
    core = F.lit(True)
    for k in AXES:
        core = core & (F.col(f"t{k}") == F.floor(F.col(k) / size))
    return voxels.withColumn("core", core)


def edge_boxes(edges: DataFrame, nodes: DataFrame, margin: int = 5) -> DataFrame:
    """(src, dst) with the least and largest coordinates of both ends, ``margin`` wider."""
    both = ends(edges, nodes)
    return both.select(
        "src", "dst",
        *((F.least(f"a{k}", f"b{k}") - margin).alias(f"lo{k}") for k in AXES),
        *((F.greatest(f"a{k}", f"b{k}") + margin).alias(f"hi{k}") for k in AXES),
    )


def ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with the coordinates of their ends, prefixes a and b."""
    for end, p in (("src", "a"), ("dst", "b")):
        edges = edges.join(nodes.select(F.col("nid").alias(end), *(F.col(k).cast("double").alias(p + k) for k in AXES)), end)
    return edges


def edges_by_creator(edges: DataFrame, nodes: DataFrame, known: list[str]) -> DataFrame:
    """(creator, n_edges, dx, dy, dz): the edges of each of the creators ``known``, and of all others as 'default', and
    the sum of their vectors from src to dst."""
    who = F.when(F.col("creator").isin(known), F.col("creator")).otherwise("default").alias("creator")
    vectors = (F.sum(c).alias("d" + k) for c, k in zip(step("a", "b"), AXES, strict=True))
    return ends(edges, nodes).groupBy(who).agg(F.count(F.lit(1)).alias("n_edges"), *vectors)


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nid, nbr) and the coordinates of both (prefixes a and b)."""
    adj = adjacency(edges)
    for end, p in (("nid", "a"), ("nbr", "b")):
        adj = adj.join(nodes.select(F.col("nid").alias(end), *(F.col(k).cast("double").alias(p + k) for k in AXES)), end)
    return adj


def local(df: DataFrame, origin: list[int], size: list[int]) -> DataFrame:
    """Rows inside the half-open box, with coordinates from its origin."""
    for k, o, s in zip(AXES, origin, size, strict=True):
        df = df.where((F.col(k) >= o) & (F.col(k) < o + s)).withColumn(k, F.col(k) - o)
    return df


def to_level(points: DataFrame, levels: DataFrame, target: int) -> DataFrame:
    """Points (level, x, y, z) on the grid of level ``target``: cut to whole numbers of its spacing."""
    own = levels.select("level", F.col("spacing").alias("own"))
    other = levels.where(F.col("level") == target).select(F.col("spacing").alias("to"))
    out = points.join(own, "level").crossJoin(F.broadcast(other))  # one row
    return out.select("nid", *((F.col(k) * F.col("own") / F.col("to")).cast("int").cast("long").alias(k) for k in AXES))


def overview_level(levels: DataFrame, below: int = 1000) -> DataFrame:
    """(level): the first level with all sizes under ``below``, else 0."""
    fits = levels.where(" and ".join(f"s{k} < {below}" for k in AXES))
    return fits.agg(F.coalesce(F.min("level"), F.lit(0)).cast("long").alias("level"))


def mirror(at: Column, size: Column) -> Column:
    """Index reflected into [0, size), the border not repeated."""
    period = F.greatest(2 * size - 2, F.lit(1))
    m = F.pmod(at, period)
    return F.when(m < size, m).otherwise(period - m)
