"""Tables of points or voxels sorted by cells, so that a box reads only the parts of the files that touch it.

A cell is a cube of voxels; its Morton number interleaves the bits of its three coordinates, so that near cells have near
numbers. A laid-out table is sorted by that number, in a column ``cell<side>``. A box becomes a few intervals of numbers,
which go down to the scan and are checked against the statistics of row groups and pages, and the box itself, which is
checked on the rows that are left.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.functions.geometry import AXES

#: Bits of a cell's coordinate, of which one is for those below 0.
BITS = 21
#: Bits that stay and distances by which they move, when a bit's place triples.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
#: Rows of a page, the least part of a file that a scan reads or leaves.
PAGE_ROWS = 1000
#: Intervals of a box at most; fewer, wider ones read more.
INTERVALS = 64


def morton(x: Column, y: Column, z: Column) -> Column:
    """The Morton number of a cell with coordinates of BITS bits, not below 0."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for by, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(x), 2).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(spread(z))


def morton_number(x: int, y: int, z: int) -> int:
    return sum(((v >> b) & 1) << (3 * b + s) for v, s in ((x, 2), (y, 1), (z, 0)) for b in range(BITS))


def cell(side: int) -> Column:
    """The cell of a row's x, y, z. A coordinate of 2^20 cells or more on either side of 0 is an error."""
    half = 1 << (BITS - 1)
    at = []
    for k in AXES:
        c = F.floor(F.col(k) / side) + half
        at.append(F.when((c >= 0) & (c < 2 * half), c).otherwise(F.raise_error(F.lit("a coordinate is out of the grid's reach")).cast("long")))
    return morton(*at)


def write_cells(df: DataFrame, path: str, side: int = 16) -> None:
    """``df`` (x, y, z and others) as a table sorted by cells of ``side``. Rows of one cell may fall into several files."""
    name = f"cell{side}"
    laid = df.withColumn(name, cell(side)).repartitionByRange(name, *AXES).sortWithinPartitions(name)
    laid.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def intervals(low: list[int], high: list[int], side: int, most: int = INTERVALS) -> list[tuple[int, int]]:
    """Intervals of Morton numbers, at most ``most``, that hold all cells of the half-open box from ``low`` to ``high``.

    The least cube of cells around the box is cut into eighths, the largest first, as long as that many are allowed;
    eighths outside the box go."""
    half = 1 << (BITS - 1)
    lo = [int(a // side) + half for a in low]
    hi = [int(-(-b // side)) - 1 + half for b in high]
    if any(b < a for a, b in zip(lo, hi, strict=True)):
        return []
    lo, hi = [max(a, 0) for a in lo], [min(b, 2 * half - 1) for b in hi]
    if any(b < a for a, b in zip(lo, hi, strict=True)):
        return []
    k = max((a ^ b).bit_length() for a, b in zip(lo, hi, strict=True))
    whole: list[tuple[int, int]] = []
    open_ = [(-k, tuple(a >> k << k for a in lo))]
    while open_ and len(whole) + len(open_) + 7 <= most:
        k, at = -open_[0][0], open_[0][1]
        if all(a <= c and c + (1 << k) - 1 <= b for a, b, c in zip(lo, hi, at, strict=True)):
            heapq.heappop(open_)
            whole.append((k, at))
            continue
        heapq.heappop(open_)
        for i in range(8):
            new = tuple(c + ((i >> s & 1) << (k - 1)) for c, s in zip(at, (2, 1, 0), strict=True))
            if all(c <= b and c + (1 << (k - 1)) - 1 >= a for a, b, c in zip(lo, hi, new, strict=True)):
                heapq.heappush(open_, (-(k - 1), new))
    found = sorted((morton_number(*at), k) for k, at in whole + [(-n, at) for n, at in open_])
    out: list[tuple[int, int]] = []
    for first, k in found:
        last = first + (1 << 3 * k) - 1
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def in_cells(df: DataFrame, low: list[int], high: list[int]) -> DataFrame:
    """Rows of a laid-out table in the half-open box from ``low`` to ``high``, without the cell's column."""
    name = next(c for c in df.columns if re.fullmatch(r"cell\d+", c))
    of = F.lit(False)
    for first, last in intervals(low, high, int(name[4:])):
        of = of | F.col(name).between(first, last)
    df = df.where(of)
    for k, a, b in zip(AXES, low, high, strict=True):
        df = df.where((F.col(k) >= a) & (F.col(k) < b))
    return df.drop(name)


def read_box(spark: SparkSession, path: str, low: list[int], high: list[int]) -> DataFrame:
    """The rows of the laid-out table at ``path`` in a box."""
    return in_cells(spark.read.parquet(path), low, high)
