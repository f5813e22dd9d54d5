"""Dense arrays of voxels: tiles with halos for scorers, and many crops at once for models.

Voxels are packed into binary tiles once. Tiles with halos are made by an exchange: each tile sends the slabs at its faces,
edges and corners to its neighbours, so that a voxel row moves once and what moves again is bytes. Crops share the
tiles that they touch, block by block. A task holds one tile, or one crop and the tiles of a block, at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.functions.geometry import AXES
from tracegraph.operators.grid import mirror
from tracegraph.operators.voxels import beside_tiles, packed_tiles
from tracegraph.store import saved

Filter = Callable[[np.ndarray], np.ndarray]
PART = "tx long, ty long, tz long, own boolean, ox long, oy long, oz long, sx long, sy long, sz long, data binary, has binary"


def dense_min_max(block: np.ndarray) -> np.ndarray:
    """The default scorer: min-max normalised values; 0 in a flat block."""
    lo, hi = float(block.min()), float(block.max())
    return (block - lo) / (hi - lo) if hi > lo else np.zeros(block.shape)


def clipped(share: float = 0.9999) -> Filter:
    """A pre-filter: values above the one at sorted place int(share n) - 1 are cut to it, and all are min-max normalised."""

    def run(block: np.ndarray) -> np.ndarray:
        at = max(int(block.size * share) - 1, 0)
        return dense_min_max(np.minimum(block, np.partition(block.ravel(), at)[at]))

    return run


def exchanged(voxels: DataFrame, image: list[int], size: int, halo: int) -> DataFrame:
    """The parts of tiles of side ``size`` with a halo: each tile of the image (sizes ``image``) that has voxels, and what
    it lends to each of its neighbours. Needs halo <= size."""
    count = [-(-n // size) for n in image]

    def run(cube: pd.DataFrame) -> pd.DataFrame:
        at = [int(cube[k].iloc[0]) // size for k in AXES]
        deep = [min(size, n - t * size) for n, t in zip(image, at, strict=True)]
        place = tuple(cube[k].to_numpy() - t * size for k, t in zip(AXES, at, strict=True))
        values, has = np.zeros(deep, "<i4"), np.zeros(deep, bool)
        values[place], has[place] = cube["v"].to_numpy(), True
        rows = []
        for o in product((-1, 0, 1), repeat=3):
            to = [t + d for t, d in zip(at, o, strict=True)]
            if all(0 <= t < c for t, c in zip(to, count, strict=True)):
                cut = tuple(slice(max(n - halo, 0), n) if d > 0 else slice(0, min(halo, n)) if d < 0 else slice(0, n) for d, n in zip(o, deep, strict=True))
                part = values[cut]
                if part.size:
                    corner = [t * size + c.start for t, c in zip(at, cut, strict=True)]
                    own = o == (0, 0, 0)
                    rows.append((*to, own, *corner, *part.shape, part.tobytes(), np.packbits(has).tobytes() if own else None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PART.split(", ")])

    inside = voxels
    for k, n in zip(AXES, image, strict=True):
        inside = inside.where((F.col(k) >= 0) & (F.col(k) < n))
    rows = inside.select(*(F.col(k).cast("long").alias(k) for k in AXES), F.col("v").cast("int").alias("v"))
    return rows.groupBy(*(F.floor(F.col(k) / size) for k in AXES)).applyInPandas(run, PART)


def assembled(parts: pd.DataFrame, image: list[int], size: int, halo: int) -> tuple[np.ndarray, np.ndarray, list[int]] | None:
    """The dense block of side size + 2 halo of a tile's parts, which of its own voxels are there, and its corner; None if
    the tile has none. Beyond the image, and where the last tile is short, the block is mirrored, its border not repeated."""
    mine = parts[parts["own"]]
    if not len(mine):
        return None
    at = [int(parts[t].iloc[0]) for t in ("tx", "ty", "tz")]
    lo = [max(0, t * size - halo) for t in at]
    hi = [min(n, (t + 1) * size + halo) for n, t in zip(image, at, strict=True)]
    block = np.zeros([b - a for a, b in zip(lo, hi, strict=True)], np.int32)
    for row in parts.itertuples(index=False):
        cut = tuple(slice(o - a, o - a + s) for o, a, s in zip((row.ox, row.oy, row.oz), lo, (row.sx, row.sy, row.sz), strict=True))
        block[cut] = np.frombuffer(row.data, "<i4").reshape(row.sx, row.sy, row.sz)
    low = [halo - (t * size - a) for t, a in zip(at, lo, strict=True)]
    block = np.pad(block, [(p, size + 2 * halo - p - n) for p, n in zip(low, block.shape, strict=True)], mode="reflect")
    deep = mine[["sx", "sy", "sz"]].iloc[0].tolist()
    has = np.unpackbits(np.frombuffer(mine["has"].iloc[0], np.uint8), count=int(np.prod(deep))).astype(bool).reshape(deep)
    return block, has, [t * size for t in at]


def score_dense(voxels: DataFrame, image: list[int], size: int = 100, halo: int = 4, scorer: Filter = dense_min_max, before: Filter | None = None) -> DataFrame:
    """(x, y, z, v, norm): each voxel of the image with its score. ``scorer`` gets a dense block of side size + 2 halo, a
    voxel without a row being 0, and gives one of the same shape, of which the tile's own part counts; ``before`` is applied
    to the block first."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        found = assembled(parts, image, size, halo)
        if found is None:
            return pd.DataFrame(columns=["x", "y", "z", "v", "norm"])
        block, has, corner = found
        scores = scorer(before(block) if before else block)
        own = tuple(slice(halo, halo + n) for n in has.shape)
        place = np.argwhere(has)
        out = pd.DataFrame(place + corner, columns=list(AXES))
        out["v"], out["norm"] = block[own][has], scores[own][has]
        return out

    kind = dict(voxels.dtypes)
    return exchanged(voxels, image, size, halo).groupBy("tx", "ty", "tz").applyInPandas(run, f"x {kind['x']}, y {kind['y']}, z {kind['z']}, v {kind['v']}, norm double")


def _sources(first: Column, size: int, n: int, padding: str) -> Column:
    """The voxels of an axis of length ``n`` that a crop from ``first`` shows, -1 for none."""
    places = F.sequence(first, first + (size - 1))
    return F.transform(places, lambda p: mirror(p, F.lit(n)) if padding == "reflect" else F.when((p >= 0) & (p < n), p).otherwise(-1))


def with_crops(rois: DataFrame, voxels: DataFrame, size: int, image: list[int], run: Callable[[pd.Series, np.ndarray], tuple], returns: str, padding: str = "constant", side: int = 16) -> DataFrame:
    """What ``run`` makes of each of ``rois`` (roi, a number of its own for each row, x0, y0, z0 and others) and its crop, a
    dense cube of ``size`` voxels from x0, y0, z0: a row of type ``returns``. Outside the image (sizes ``image``) the crop is
    0, or, with padding ``reflect``, mirrored; a voxel without a row is 0."""
    tiles = saved(packed_tiles(slab_of(voxels, image), side), "tiles")
    at = rois
    for k, n in zip(AXES, image, strict=True):
        at = at.withColumn("_s" + k, _sources(F.floor(F.col(k + "0")).cast("long"), size, n, padding))
    for k in AXES:
        keys = F.array_distinct(F.transform(F.filter("_s" + k, lambda s: s >= 0), lambda s: F.floor(s / side)))
        at = at.withColumns({"_c" + k: F.floor(F.col(k + "0")), "_t" + k: keys})

    def crops_of(own: pd.DataFrame, tiles: dict[tuple, bytes]) -> pd.DataFrame:
        # the tiles as one array, with a layer of zeros behind the last on each axis for all that is nowhere
        known = [np.unique([t[i] for t in tiles]).astype(np.int64) for i in range(3)]
        block = np.zeros([len(n) * side + 1 for n in known], np.int32)
        for t, data in tiles.items():
            first = [int(np.searchsorted(n, i)) * side for n, i in zip(known, t, strict=True)]
            block[tuple(slice(f, f + side) for f in first)] = np.frombuffer(data, "<i4").reshape(side, side, side)
        made = []
        for i in range(len(own)):
            row = own.iloc[i]
            places = []
            for k, n in zip(AXES, known, strict=True):
                s = np.asarray(row["_s" + k])
                there = (s >= 0) & np.isin(s // side, n)
                places.append(np.where(there, np.searchsorted(n, s // side) * side + s % side, len(n) * side))
            made.append(run(row, block[np.ix_(*places)]))
        return pd.DataFrame(made, columns=[c.split()[0] for c in returns.split(", ")])

    return beside_tiles(at, tiles, crops_of, returns)


def slab_of(voxels: DataFrame, image: list[int]) -> DataFrame:
    for k, n in zip(AXES, image, strict=True):
        voxels = voxels.where((F.col(k) >= 0) & (F.col(k) < n))
    return voxels


def crops(rois: DataFrame, voxels: DataFrame, size: int, image: list[int], padding: str = "constant") -> DataFrame:
    """(roi, crop): the crops as little-endian 32-bit numbers, x first."""
    kind = dict(rois.dtypes)["roi"]
    return with_crops(rois, voxels, size, image, lambda row, cube: (row["roi"], cube.astype("<i4").tobytes()), f"roi {kind}, crop binary", padding)


def unpacked(crops_: DataFrame, size: int) -> DataFrame:
    """(roi, x, y, z, v): every voxel of crops, coordinates from their own corner."""
    i = F.col("i")
    word = lambda at: F.conv(F.concat(*(F.substring("h", at * 8 + 1 + 2 * b, F.lit(2)) for b in (3, 2, 1, 0))), 16, 10).cast("long")
    rows = crops_.select("roi", F.hex("crop").alias("h")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size**3 - 1))))
    return rows.select("roi", F.floor(i / size**2).alias("x"), (F.floor(i / size) % size).alias("y"), (i % size).cast("long").alias("z"), word(i).alias("v"))
