"""Column expressions on points and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def norm(v: Sequence[Column]) -> Column:
    return F.sqrt(sum(c * c for c in v))


def step(a: str, b: str) -> list[Column]:
    """Vector from the point columns with prefix ``a`` to those with prefix ``b``."""
    return [F.col(f"{b}{k}") - F.col(f"{a}{k}") for k in AXES]


def angle(u: Sequence[Column], v: Sequence[Column]) -> Column:
    """Degrees between two vectors, rounded to 6 places; null if one is zero. From the lengths of their cross and dot
    products, which is as exact near 0 and 180 as elsewhere."""
    (a, b, c), (x, y, z) = u, v
    across = norm([b * z - c * y, c * x - a * z, a * y - b * x])
    return F.when((norm(u) > 0) & (norm(v) > 0), F.round(F.degrees(F.atan2(across, a * x + b * y + c * z)), 6))


def in_box(origin: Sequence[Column], size: Sequence[Column], prefix: str = "") -> Column:
    """Whether a point lies in the half-open box."""
    out = F.lit(True)
    for k, o, s in zip(AXES, origin, size, strict=True):
        out = out & (F.col(prefix + k) >= o) & (F.col(prefix + k) < o + s)
    return out


def every_third(points: Column, k: int = 3) -> Column:
    """Down-sampling of a path: every k-th point up to the last but k - 1, and the last."""
    n = F.size(points)
    return F.filter(points, lambda p, i: ((i % k == 0) & (i < n - (k - 1))) | (i == n - 1))
