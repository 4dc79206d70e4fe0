"""Geometric column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def sq_dist(a: str, b: str) -> Column:
    """Squared distance of the points in columns ``{a}x ...`` and ``{b}x ...``."""
    dx, dy, dz = (F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in XYZ)
    return dx * dx + dy * dy + dz * dz


def cell(size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), prefix: str = "") -> list[Column]:
    """Integer grid cell of a point, as columns cx, cy, cz."""
    return [F.floor((F.col(f"{prefix}{c}") - F.lit(float(o))) / F.lit(float(size))).alias(f"c{c}") for c, o in zip(XYZ, origin, strict=True)]


def moved(matrix: list[list[float]]) -> list[Column]:
    """x, y, z under a 4 x 4 transform: three linear expressions."""
    return [(F.lit(float(r[0])) * F.col("x") + F.lit(float(r[1])) * F.col("y") + F.lit(float(r[2])) * F.col("z") + F.lit(float(r[3]))).alias(c) for c, r in zip(XYZ, matrix, strict=False)]


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Ascending eigenvalues of a symmetric 3 x 3 matrix in closed form (trigonometric)."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    half_det = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.least(F.greatest(half_det, F.lit(-1.0)), F.lit(1.0))) / 3
    high = F.when(p == 0, q).otherwise(q + 2 * p * F.cos(phi))
    low = F.when(p == 0, q).otherwise(q + 2 * p * F.cos(phi + F.lit(2 * math.pi / 3)))
    return low, 3 * q - low - high, high


def colormap(value: Column, low: float = 11, high: float = 48) -> list[Column]:
    """Sine colour map of a scalar in [low, high] to r, g, b in [0, 1]; null outside."""
    i = (value - F.lit(float(low))) * 255 / F.lit(float(high - low))
    ok = (value >= low) & (value <= high)
    return [F.when(ok, F.bround(F.sin(i * 0.024 + shift) * 127 + 128) / 255).alias(c) for c, shift in zip("rgb", (0, 2, 4), strict=True)]
