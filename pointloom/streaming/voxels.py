"""Voxel means of points that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spatial


def voxel_means(points: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Running (cx, cy, cz, n, x, y, z): one state row per occupied voxel, however many points
    fall into it. The grid's origin is fixed, since a stream has no minimum."""
    return points.select("x", "y", "z", *spatial.cell(size, origin)).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def recent_voxels(points: DataFrame, size: float, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Voxel means by tumbling window; the watermark bounds the state."""
    held = points.withWatermark(time, late).select(F.window(time, window).alias("w"), "x", "y", "z", *spatial.cell(size))
    return held.groupBy("w", "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"])
