"""Sparse voxels (x, y, z, v), alone or by tile or image, as rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tracegraph.functions.geometry import AXES, norm, step
from tracegraph.operators.components import hook, star_edges
from tracegraph.operators.graph import adjacency, degree, induced, spanning_forest
from tracegraph.operators.grid import box_pairs, haloed
from tracegraph.operators.numbers import numbered
from tracegraph.operators.paths import paths
from tracegraph.store import saved, tasks

#: Half of the 26 neighbours: each pair of voxels once.
FORWARD = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
BASE = 1 << 20
#: Side of a packed cube of voxels.
TILE = 8


def voxel_id(prefix: str = "") -> Column:
    """One number for a voxel that ``checked`` lets through."""
    x, y, z = (F.col(prefix + k).cast("long") for k in AXES)
    return (x * BASE + y) * BASE + z


def checked(voxels: DataFrame) -> DataFrame:
    """``voxels``; a coordinate below 0 or not below BASE is an error, as it would share its number with another voxel's."""
    for k in AXES:
        wrong = F.raise_error(F.lit(f"a voxel coordinate is below 0 or not below {BASE}")).cast(dict(voxels.dtypes)[k])
        voxels = voxels.withColumn(k, F.when(F.col(k).between(0, BASE - 1), F.col(k)).otherwise(wrong))
    return voxels


def _offsets(df: DataFrame, name: str = "o") -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*(F.struct(*(F.lit(c).alias(k) for c, k in zip(o, AXES, strict=True))) for o in FORWARD))))


def touching(voxels: DataFrame, *keys: str) -> DataFrame:
    """(keys, src, dst): pairs of 26-neighbours, by voxel id."""
    moved = _offsets(voxels.select(*keys, *AXES)).select(*keys, voxel_id().alias("src"), *((F.col(k) + F.col(f"o.{k}")).alias(k) for k in AXES))
    return moved.join(voxels.select(*keys, *AXES), [*keys, *AXES]).select(*keys, "src", voxel_id().alias("dst"))


def min_max(voxels: DataFrame, *keys: str) -> DataFrame:
    """``voxels`` with norm, (v - min) / (max - min) of the tile; 0 in a flat tile."""
    got = voxels.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    out = voxels.join(got, list(keys)) if keys else voxels.crossJoin(F.broadcast(got))  # got: one row
    return out.withColumn("norm", F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")


def clip_normalise(voxels: DataFrame, *keys: str, share: float = 0.9999) -> DataFrame:
    """``voxels`` with lo, hi (the values at sorted places 0 and int(share n) - 1 of the tile) and norm of the clipped value.

    Places come from counts of equal values: a running sum over distinct values, never a sort of all voxels of a tile.
    """
    counts = voxels.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    upto = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(W.partitionBy(*keys)))
    at = F.greatest(F.floor(F.col("n") * share) - 1, F.lit(0))
    cut = placed.groupBy(*keys).agg(F.min("v").alias("lo"), F.min(F.when(F.col("upto") > at, F.col("v"))).alias("hi"))
    out = voxels.join(cut, list(keys))
    clipped = F.least(F.col("v"), F.col("hi"))
    return out.withColumn("norm", F.when(F.col("hi") > F.col("lo"), (clipped - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))


def denormalise(df: DataFrame) -> DataFrame:
    """The inverse: v of norm, lo and hi, clipped to 16 bits."""
    v = F.round(F.col("norm") * (F.col("hi") - F.col("lo")) + F.col("lo"), 6)  # what norm has lost must not cost a whole number
    return df.withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(65535.0), v)).cast("int"))


def mask(scored: DataFrame, least: float = 0.5, background: int = 150) -> DataFrame:
    return scored.where((F.col("norm") >= least) & (F.col("v") > background))


def default_scorer(tile: pd.DataFrame) -> np.ndarray:
    """Min-max normalised values."""
    v = tile["v"].to_numpy(float)
    return (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else np.zeros(len(v))


def score_tiles(voxels: DataFrame, size: int, halo: int = 4, scorer: Callable[[pd.DataFrame], np.ndarray] = default_scorer) -> DataFrame:
    """(x, y, z, v, norm): the scorer applied to each tile with its halo; core voxels stay. A tile bounds what a task holds."""

    return score_haloed(haloed(voxels.select(*AXES, "v"), size, halo), scorer)


def score_haloed(tiles: DataFrame, scorer: Callable[[pd.DataFrame], np.ndarray] = default_scorer) -> DataFrame:
    """The same for tiles (tx, ty, tz, x, y, z, v, core) that come with their halos."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile["norm"] = scorer(tile)
        return tile.loc[tile["core"], ["x", "y", "z", "v", "norm"]]

    kind = dict(tiles.dtypes)
    return tiles.groupBy("tx", "ty", "tz").applyInPandas(run, f"x {kind['x']}, y {kind['y']}, z {kind['z']}, v {kind['v']}, norm double")


def local_regions(places: np.ndarray) -> np.ndarray:
    """For each of some voxels (n x 3) the first of them, in their order, that it is 26-connected to among them."""
    corner = places.min(0) - 1
    at = np.full(places.max(0) - corner + 2, -1, np.int64)
    at[tuple((places - corner).T)] = np.arange(len(places))
    root = np.arange(len(places))
    for o in FORWARD:
        other = at[tuple((places - corner + o).T)]
        here = np.flatnonzero(other >= 0)
        hook(root, here, other[here])
    return root


#: Side of the cubes in which voxels are first joined.
CUBE = 32


def regions(voxels: DataFrame, side: int = CUBE, *keys: str) -> DataFrame:
    """``voxels`` with region, the least voxel id of the 26-connected region. With ``keys`` only voxels of equal keys touch;
    a voxel has one.

    Voxels of a cube of ``side`` are joined in one task and get the least id as a label. Only those at a cube's faces, edges
    and corners then look for neighbours, across them; labels that touch there are joined as a graph."""
    own = checked(voxels).withColumn("_id", voxel_id())
    names = own.columns

    def run(cube: pa.Table) -> pa.Table:
        cube = cube.sort_by("_id")
        places = np.stack([cube.column(k).to_numpy().astype(np.int64) for k in AXES], 1)
        ids = cube.column("_id").to_numpy()
        first = np.unique(ids, return_index=True)[1]  # rows may repeat a voxel
        of = np.searchsorted(ids[first], ids)
        return cube.append_column("_label", pa.array(ids[first][local_regions(places[first])][of]))

    cubes = [F.floor(F.col(k) / side) for k in AXES]
    labelled = own.groupBy(*keys, *cubes).applyInArrow(lambda cube: run(cube.select(names)), T.StructType([*own.schema.fields, T.StructField("_label", T.LongType())]))
    labelled = saved(labelled, "labelled")
    at = labelled.select("_label", *keys, *(F.col(k).cast("long").alias(k) for k in AXES))
    face = F.lit(False)
    for k in AXES:
        face = face | (F.col(k) % side == 0) | (F.col(k) % side == side - 1)
    shell = at.where(face)
    across = F.lit(False)
    for k in AXES:
        across = across | (F.floor(F.col(k) / side) != F.floor((F.col(k) + F.col("o." + k)) / side))
    moved = _offsets(shell).where(across).select(F.col("_label").alias("src"), *keys, *((F.col(k) + F.col("o." + k)).alias(k) for k in AXES))
    links = moved.join(shell.withColumnRenamed("_label", "dst"), [*keys, *AXES]).select("src", "dst").distinct()
    found = star_edges(links).withColumnRenamed("nid", "_label")
    return labelled.join(found, "_label", "left").select(*voxels.columns, F.coalesce("comp", "_label").alias("region"))


def large_regions(voxels: DataFrame, least: int = 50, *keys: str) -> DataFrame:
    out = saved(regions(voxels, CUBE, *keys), "regions")
    return out.join(out.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least), "region")


def inner_voxels(voxels: DataFrame, size: int, image: list[int]) -> DataFrame:
    """``voxels`` without the border of one voxel of each tile of side ``size``; the last tiles end with the image."""
    for k, n in zip(AXES, image, strict=True):
        first = F.floor(F.col(k) / size) * size
        voxels = voxels.where((F.col(k) > first) & (F.col(k) < F.least(first + size, F.lit(n)) - 1))
    return voxels


def tile_segments(mask_: DataFrame, size: int, image: list[int], least: int = 50, longer_than: int = 6) -> DataFrame:
    """(sid, ord, x, y, z): segments of each tile of side ``size`` by itself, as they come when tiles are worked on one at a
    time: regions of fewer than ``least`` voxels inside the tile go, the border of one voxel of what is left is cleared, and
    no chain crosses into the next tile."""
    tiled = mask_.select(*AXES, *(F.floor(F.col(k) / size).alias("t" + k) for k in AXES))
    kept = large_regions(tiled, least, "tx", "ty", "tz")
    return skeleton_segments(inner_voxels(kept, size, image), longer_than, "tx", "ty", "tz")


def border_links(segments: DataFrame, size: int, reach: int = 3) -> DataFrame:
    """(src, dst, turn): ends of chains in different tiles of side ``size``, as voxel ids, to be joined across the tiles'
    border: at most ``reach`` voxels apart on each axis, the nearest first (turn is their distance), each end once. Cleared
    borders leave ends 3 voxels apart."""
    last = segments.groupBy("sid").agg(F.max("ord").alias("last")).where("last > 0")
    ends = segments.join(last, "sid").where("ord = 0 or ord = last").select(voxel_id().alias("nid"), *AXES)
    ends = saved(ends, "ends")
    apart = F.lit(False)
    for k in AXES:
        apart = apart | (F.floor(F.col(k) / size) != F.floor(F.col("m" + k) / size))
    pairs = box_pairs(ends, ends, reach).where("nid < m").where(apart)
    return pairs.select(F.col("nid").alias("src"), F.col("m").alias("dst"), F.round(norm(step("", "m")), 6).alias("turn"))


def skeleton_segments(voxels: DataFrame, longer_than: int = 6, *keys: str) -> DataFrame:
    """(sid, ord, x, y, z): chains of skeleton voxels and, as segments of one point, branch voxels of degree 3. With
    ``keys`` only voxels of equal keys touch; a voxel has one.

    Neighbours form a forest in each region; branch voxels and their neighbours go, and chains of more than
    ``longer_than`` voxels with two ends stay. sid is the least voxel id of a chain, or minus a branch voxel's id less 1.
    """
    nodes = saved(checked(voxels).select(voxel_id().alias("nid"), *AXES, *keys), "skeleton")
    forest = saved(spanning_forest(touching(nodes, *keys)), "forest")
    deg = saved(degree(nodes.select("nid"), forest), "degrees")
    branch = deg.where("degree >= 3").select("nid")
    around = adjacency(forest).join(branch, "nid", "left_semi").select(F.col("nbr").alias("nid"))
    rest = saved(nodes.select("nid").join(branch.union(around).distinct(), "nid", "left_anti"), "rest")
    chains = paths(rest, induced(rest, forest), longer_than).withColumnRenamed("comp", "sid")
    single = deg.where("degree = 3").select((-F.col("nid") - 1).alias("sid"), F.lit(0).cast("long").alias("ord"), "nid")
    return chains.unionByName(single).join(nodes, "nid").select("sid", "ord", *AXES)


def packed_tiles(voxels: DataFrame, size: int = TILE) -> DataFrame:
    """(tx, ty, tz, tile): the values of a cube of voxels as little-endian 32-bit numbers, x first; 0 where there is none."""

    def run(cube: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((size, size, size), "<i4")
        values[tuple(cube[k].to_numpy() % size for k in AXES)] = cube["v"].to_numpy()
        return pd.DataFrame([(*(cube[k].iloc[0] // size for k in AXES), values.tobytes())], columns=["tx", "ty", "tz", "tile"])

    rows = voxels.select(*(F.col(k).cast("long").alias(k) for k in AXES), F.col("v").cast("int").alias("v"))
    return rows.groupBy(*(F.floor(F.col(k) / size) for k in AXES)).applyInPandas(run, "tx long, ty long, tz long, tile binary")


#: What a cost of 1 is in whole numbers, and more than any way costs.
UNIT, FAR = 10**9, 1 << 60


def _least_lengths(shape: tuple, end: np.ndarray) -> np.ndarray:
    """The length of the straightest 26-connected steps from each voxel of a box to ``end``."""
    x, y, z = (np.abs(np.arange(n) - e).reshape([-1 if i == j else 1 for j in range(3)]) for i, (n, e) in enumerate(zip(shape, end, strict=True)))
    most, fewest = np.maximum(np.maximum(x, y), z), np.minimum(np.minimum(x, y), z)
    return most + (np.sqrt(2) - 1) * (x + y + z - most - fewest) + (np.sqrt(3) - np.sqrt(2)) * fewest


def cheapest_way(bright: np.ndarray, start: tuple, end: tuple) -> tuple[np.ndarray, float]:
    """``cheapest_ways`` of one box."""
    return cheapest_ways([(bright, start, end)])[0]


def cheapest_ways(boxes: list[tuple[np.ndarray, tuple, tuple]]) -> list[tuple[np.ndarray, float]]:
    """For each box (bright, start, end) the voxels (n x 3) of the cheapest 26-connected way through it, ends included, and
    its cost; a step costs its length over the brightness (more than 0, at most 1) of the voxel it enters. Ties go to the
    lower voxel.

    Costs are whole numbers of 1e-9. Layers of open voxels are relaxed, the cheaper part at a time, in all boxes at once,
    until none is left. A voxel is left out if its cost and the length of the straightest steps from it to the end, which no
    way there can cost less than, are more than a known way costs, first that of the straightest steps: so every voxel of a
    cheapest way gets its least cost. As no step costs less than 1, all within 1 of the cheapest are final at once.
    """
    shapes = np.array([b.shape for b, _, _ in boxes]) + 2
    sizes = shapes.prod(1)
    base, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    strides = np.stack([shapes[:, 1] * shapes[:, 2], shapes[:, 2], np.ones(len(boxes), np.int64)], 1)
    light, least = np.ones(n), np.full(n, FAR)
    for (bright, _, end), shape, i, size in zip(boxes, shapes, base, sizes, strict=True):
        light[i : i + size].reshape(shape)[1:-1, 1:-1, 1:-1] = bright
        least[i : i + size].reshape(shape)[1:-1, 1:-1, 1:-1] = np.floor(_least_lengths(bright.shape, np.array(end, np.int64)) * UNIT).astype(np.int64) - 10_000
    moves = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)])
    move, entered = strides @ moves.T, ((moves**2).sum(1) - 1) * n
    price = np.rint(np.sqrt([[1.0], [2.0], [3.0]]) / light * UNIT).astype(np.int64).ravel()
    at, ends = (np.array([box[i] for box in boxes], np.int64) for i in (1, 2))
    a, b = (base + ((p + 1) * strides).sum(1) for p in (at, ends))
    known = np.zeros(len(boxes), np.int64)
    while (at != ends).any():
        by = np.sign(ends - at)
        at = at + by
        kind = np.abs(by).sum(1)
        known += np.where(kind > 0, price[np.maximum(kind - 1, 0) * n + base + ((at + 1) * strides).sum(1)], 0)
    box_of = np.repeat(np.arange(len(boxes)), sizes)
    cost, waits, open_ = np.full(n, FAR), np.zeros(n, bool), a
    cost[a] = 0
    while len(open_):
        now, box = cost[open_], box_of[open_]
        begin = np.flatnonzero(np.diff(box, prepend=-1))
        count = np.diff(begin, append=len(box))
        now = now <= np.repeat(np.maximum(np.minimum.reduceat(now, begin) + UNIT - UNIT // 1000, np.add.reduceat(now, begin) // count), count)
        from_, box = open_[now], box[now]
        waits[from_] = False
        to = from_[:, None] + move[box]
        new = cost[from_][:, None] + price[to + entered]
        better = new < cost[to]
        # outside the boxes nothing is
        better[better] = new[better] + least[to[better]] <= np.repeat(known[box], better.sum(1))
        to = to[better]
        np.minimum.at(cost, to, new[better])
        waits[to] = True
        known = np.minimum(known, cost[b])
        open_ = np.flatnonzero(waits)
        open_ = open_[cost[open_] + least[open_] <= known[box_of[open_]]]
    ways, back = [b], b
    while (back != a).any():
        before = back[:, None] + move
        first = (cost[before] + price[back[:, None] + entered] == cost[back][:, None]).argmax(1)
        back = np.where(back == a, a, before[np.arange(len(back)), first])
        ways.append(back)
    found = []
    for i, way in enumerate(np.stack(ways, 1)):
        way = way[: int(np.flatnonzero(way == a[i])[0]) + 1]
        found.append((np.stack(np.unravel_index(way[::-1] - base[i], shapes[i]), 1) - 1, float(cost[b[i]]) / UNIT))
    return found


#: Side of the blocks that boxes begin in, boxes of a block that are solved beside one set of tiles, and voxels of boxes that
#: are solved at once.
BLOCK, BESIDE, AT_ONCE = 64, 512, 1 << 18


def beside_tiles(boxes: DataFrame, tiles: DataFrame, run: Callable[[pd.DataFrame, dict[tuple, bytes]], pd.DataFrame], returns: str) -> DataFrame:
    """What ``run`` makes of ``boxes`` and the packed tiles that they touch, as rows of type ``returns``. A box has a key of
    its own, corners _cx, _cy, _cz and arrays _tx, _ty, _tz of the numbers of its tiles on each axis.

    Boxes that begin in one block, up to BESIDE or so at a time, share their tiles: a tile moves once for all of them, not
    once for each. A task holds the tiles of a block and of the reach of a box around it.
    """
    at = [f"_b{k}" for k in AXES]
    boxes = boxes.withColumns({"_b" + k: F.floor(F.col("_c" + k) / BLOCK) for k in AXES})
    parts = boxes.groupBy(at).agg(F.ceil(F.count(F.lit(1)) / BESIDE).alias("_parts"))
    boxes = saved(boxes.join(parts, at).withColumn("_part", F.pmod(F.xxhash64(*(c for c in boxes.columns if not c.startswith("_"))), "_parts")).drop("_parts"), "boxes")
    at.append("_part")
    of = ["of" + c for c in at]
    needed = boxes.select(*(F.col(c).alias(n) for c, n in zip(at, of, strict=True)), "_tx", "_ty", "_tz").distinct()
    for k in AXES:
        needed = needed.withColumn("t" + k, F.explode("_t" + k)).drop("_t" + k)
    needed = needed.distinct().join(tiles, ["tx", "ty", "tz"])

    def solve(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        return run(own, {(x, y, z): tile for x, y, z, tile in near[["tx", "ty", "tz", "tile"]].itertuples(index=False)})

    # few bytes, much work: dealt out, as Spark would otherwise put small partitions together into one task
    n = tasks(boxes.sparkSession)
    return boxes.repartition(n, *at).groupBy(at).cogroup(needed.repartition(n, *of).groupBy(of)).applyInPandas(solve, returns)


def brightest_paths(edges: DataFrame, voxels: DataFrame, margin: int = 5) -> DataFrame:
    """(edge, ord, x, y, z, cost): the cheapest 26-connected way between the ends of each edge (edge, ax..az, bx..bz) in
    the box around it; a step costs its length over the brightness of the voxel it enters, at least 1e-3. ``edge`` is a
    number of its own for each row. Ties go to the lower voxel.

    Every voxel of a box can be entered, so each edge has its cheapest way; only one with an end outside the image (a
    coordinate below 0) gets its two ends instead, with a null cost. A task holds boxes of AT_ONCE voxels, or one
    box, at a time, and the tiles of one block (see ``beside_tiles``).
    """
    at = edges.select("edge", *(F.col(p + k).cast("long").alias(p + k) for p in "ab" for k in AXES))
    for k in AXES:
        lo, hi = F.greatest(F.lit(0), F.least(f"a{k}", f"b{k}") - margin), F.greatest(F.lit(0), F.greatest(f"a{k}", f"b{k}") + margin)
        at = at.withColumns({"_c" + k: lo, "_t" + k: F.sequence(F.floor(lo / TILE), F.floor(hi / TILE))})
    tiles = saved(packed_tiles(voxels.where("x >= 0 and y >= 0 and z >= 0")), "tiles")

    def cut(lo: np.ndarray, hi: np.ndarray, tiles: dict[tuple, bytes]) -> np.ndarray:
        values = np.zeros(hi - lo, np.float64)
        for t in product(*(range(i // TILE, (j - 1) // TILE + 1) for i, j in zip(lo, hi, strict=True))):
            if t in tiles:
                corner = np.array(t) * TILE
                first, last = np.maximum(corner, lo), np.minimum(corner + TILE, hi)
                cut = tuple(slice(*c) for c in zip(first - corner, last - corner, strict=True))
                values[tuple(slice(*c) for c in zip(first - lo, last - lo, strict=True))] = np.frombuffer(tiles[t], "<i4").reshape(TILE, TILE, TILE)[cut]
        values -= values.min()
        return np.maximum(values / (values.max() or 1), 1e-3)

    def run(own: pd.DataFrame, tiles: dict[tuple, bytes]) -> pd.DataFrame:
        made, held = [], []
        a, b = (own[[p + k for k in AXES]].to_numpy(np.int64) for p in "ab")
        lo, hi = np.maximum(np.minimum(a, b) - margin, 0), np.maximum(a, b) + margin + 1
        volume = (hi - lo).prod(1)
        edge = own["edge"].to_numpy()
        outside = np.minimum(a, b).min(1) < 0

        def put(i: int, way: np.ndarray, total: float) -> None:
            made.append((np.full(len(way), edge[i]), np.arange(len(way)), *way.T, np.full(len(way), total)))

        def solve() -> None:
            for i, (way, total) in zip(held, cheapest_ways([(cut(lo[i], hi[i], tiles), a[i] - lo[i], b[i] - lo[i]) for i in held]) if held else [], strict=True):
                put(i, way + lo[i], total)
            held.clear()

        # boxes of about one size, so that they take about as many rounds
        for i in np.argsort(volume, kind="stable").tolist():
            if outside[i]:
                put(i, np.stack([a[i], b[i]]), np.nan)
                continue
            if held and (len(held) + 1) * volume[i] > AT_ONCE:
                solve()
            held.append(i)
        solve()
        out = pd.DataFrame({c: np.concatenate(v) for c, v in zip(("edge", "ord", *AXES, "cost"), zip(*made, strict=True), strict=True)})
        return out.astype({"cost": "Float64"})

    return beside_tiles(at, tiles, run, f"edge {dict(edges.dtypes)['edge']}, ord long, x long, y long, z long, cost double")


def along(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """``points`` (x, y, z and others) with the value v of their voxel, 0 where there is none."""
    cut = points.select("*", *(F.col(k).cast("int").alias("v" + k) for k in AXES))
    found = voxels.select(*(F.col(k).alias("v" + k) for k in AXES), "v")
    return cut.join(found, ["vx", "vy", "vz"], "left").withColumn("v", F.coalesce("v", F.lit(0))).drop("vx", "vy", "vz")


def dense_skeleton(chains: DataFrame, voxels: DataFrame, margin: int = 5) -> DataFrame:
    """(x, y, z): the voxels of the brightest paths between consecutive points of chains (comp, ord, nid, x, y, z)."""
    along_ = W.partitionBy("comp").orderBy("ord")
    steps = chains.select("nid", *(F.col(k).alias("a" + k) for k in AXES), *(F.lead(k).over(along_).alias("b" + k) for k in AXES)).where("bx is not null")
    return brightest_paths(steps.withColumnRenamed("nid", "edge"), voxels, margin).select(*AXES).distinct()


def rank_filter(voxels: DataFrame, size: list[int], radius: int = 5, tile: int = 16) -> DataFrame:
    """``voxels`` with rank, the share of the ball around each that is darker, and norm, its min-max normalised value in
    the image: the two channels of a track model. Beyond the image's border (sizes ``size``) it is mirrored, the border
    voxel not repeated, and a voxel without a row is 0. A task holds a tile with a margin of ``radius`` at a time."""
    spread = range(-radius, radius + 1)
    ball = np.array([(a, b, c) for a in spread for b in spread for c in spread if a * a + b * b + c * c <= radius * radius])
    at = voxels.select(*(F.col(k).cast("long").alias(k) for k in AXES), "v").withColumn("own", F.lit(True))
    for k, n in zip(AXES, size, strict=True):
        # every place within the margin at which the voxel or one of its mirror images lies
        if n == 1:
            places = F.array(*(F.lit(i).cast("long") for i in range(-radius, radius + 1)))
        else:
            period = 2 * n - 2
            turns = range(-(radius // period) - 1, radius // period + 2)
            places = F.array(*(c for i in turns for c in (F.col(k) + period * i, period * i - F.col(k))))
        near = at.withColumn("p" + k, F.explode(F.array_distinct(places)))
        at = near.where((F.col("p" + k) >= -radius) & (F.col("p" + k) < n + radius))
        first, last = F.floor((F.col("p" + k) - radius) / tile), F.floor((F.col("p" + k) + radius) / tile)
        at = at.withColumn("t" + k, F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit((n - 1) // tile)))))
        at = at.withColumn("own", F.col("own") & (F.col("p" + k) == F.col(k)) & (F.floor(F.col(k) / tile) == F.col("t" + k)))
    side = tile + 2 * radius

    def run(cube: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((side, side, side), cube["v"].to_numpy().dtype)
        place = np.stack([cube["p" + k] - cube["t" + k] * tile + radius for k in AXES], 1)
        dense[tuple(place.T)] = cube["v"]
        own = cube["own"].to_numpy()
        values, place, darker = cube["v"].to_numpy()[own], place[own], 0
        for o in ball:
            darker = darker + (dense[tuple((place + o).T)] < values)
        out = cube.loc[own, [*AXES, "v"]]
        out["rank"] = np.round(darker / len(ball), 6)
        return out

    kind = dict(voxels.dtypes)
    ranked = at.groupBy("tx", "ty", "tz").applyInPandas(run, f"x {kind['x']}, y {kind['y']}, z {kind['z']}, v {kind['v']}, rank double")
    return min_max(saved(ranked, "ranked")).withColumn("norm", F.round("norm", 6))


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """The brighter of two images at each voxel."""
    both = a.select(*AXES, F.col("v").alias("a")).join(b.select(*AXES, F.col("v").alias("b")), list(AXES), "full")
    return both.select(*AXES, F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("v"))


def union_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AXES, "m").unionByName(b.select(*AXES, "m")).groupBy(*AXES).agg(F.least(F.max("m"), F.lit(1)).alias("m"))


def match_histogram(source: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """(keys, v, to): each value of the source on the reference's scale: where its share of smaller or equal voxels falls
    among the reference's, between values in proportion, cut to whole numbers; each image of ``keys`` on its own. A value
    is of 16 bits, or the job fails: so the values of one image, which a task holds, are bounded."""

    def shares(df: DataFrame) -> DataFrame:
        wide = F.raise_error(F.lit("a voxel's value is not of 16 bits")).cast("long")
        n = df.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
        n = n.withColumn("v", F.when(F.col("v").between(0, 65535), F.col("v").cast("long")).otherwise(wide))
        upto = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
        return n.select(*keys, "v", (F.sum("c").over(upto) / F.sum("c").over(W.partitionBy(*keys))).alias("q"))

    ref = shares(reference).select(*keys, "q", F.col("v").cast("double").alias("r"), F.lit(None).cast("long").alias("v"))
    both = ref.unionAll(shares(source).select(*keys, "q", F.lit(None).cast("double"), "v"))
    below = W.partitionBy(*keys).orderBy("q", F.col("v").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    above = W.partitionBy(*keys).orderBy("q", F.col("v").isNull()).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("r").isNotNull(), F.col("q"))
    both = both.select(*keys, "v", "q", F.last("r", True).over(below).alias("r0"), F.last(known, True).over(below).alias("q0"), F.first("r", True).over(above).alias("r1"), F.first(known, True).over(above).alias("q1"))
    between = F.when(F.col("q1") > F.col("q0"), F.col("r0") + (F.col("q") - F.col("q0")) / (F.col("q1") - F.col("q0")) * (F.col("r1") - F.col("r0"))).otherwise(F.col("r0"))
    return both.where("v is not null").select(*keys, "v", F.floor(F.round(F.coalesce(between, F.col("r1"), F.col("r0")), 6)).cast("long").alias("to"))


def ray_pick(rays: DataFrame, voxels: DataFrame, size: list[int]) -> DataFrame:
    """(ray, x, y, z, v): the first brightest voxel on each ray (ray, ax..az, bx..bz), sampled every half voxel and
    clamped to the image."""
    n = F.greatest(F.ceil(norm(step("a", "b")) * 2).cast("int"), F.lit(1))
    at = rays.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    for k, s in zip(AXES, size, strict=True):
        p = F.col("a" + k) + (F.col("b" + k) - F.col("a" + k)) * F.col("i") / F.col("n")
        at = at.withColumn(k, F.greatest(F.lit(0), F.least(F.lit(s - 1), F.floor(F.round(p, 9)))).cast("int"))
    at = at.join(voxels.select(*AXES, "v"), list(AXES), "left").withColumn("v", F.coalesce("v", F.lit(0)))
    first = W.partitionBy("ray").orderBy(F.desc("v"), "i")
    return at.withColumn("r", F.row_number().over(first)).where("r = 1").select("ray", *AXES, "v")


def process_volume(
    voxels: DataFrame, size: int, background: int = 150, least: int = 50, scorer: Callable[[pd.DataFrame], np.ndarray] = default_scorer, longer_than: int = 6,
    clip: int | None = None, image: list[int] | None = None,
) -> DataFrame:
    """(sid, ord, x, y, z): tiles scored with halos, masked, small regions removed, what is left turned into segments;
    sids count from 1 over the whole volume, ready for ``tables.ingest_segments``. With ``clip``, tiles of that side of an
    image (sizes ``image``) are each worked on by themselves (``tile_segments``)."""
    found = mask(score_tiles(voxels, size, scorer=scorer), background=background)
    if clip is not None:
        found = tile_segments(saved(found.select(*AXES), "mask"), clip, image, least, longer_than)
    else:
        found = skeleton_segments(saved(large_regions(found, least).select(*AXES), "mask"), longer_than)
    found = saved(found.withColumnRenamed("sid", "of"), "segments")
    return found.join(numbered(found.select("of").distinct(), "sid", "of"), "of").select("sid", "ord", *AXES)
