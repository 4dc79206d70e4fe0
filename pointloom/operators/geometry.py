"""Local covariance, curvature, normals, and cloud measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spatial
from . import neighbors

PAIRS = ("xx", "yy", "zz", "xy", "xz", "yz")


def covariance(edges: DataFrame) -> DataFrame:
    """(id, k, xx, yy, zz, xy, xz, yz): population covariance of each neighbourhood; the
    identity where it has fewer than three points."""
    own = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"), *[F.covar_pop(f"t{p[0]}", f"t{p[1]}").alias(p) for p in PAIRS])
    return own.select("id", "k", *[F.when(F.col("k") < 3, 1.0 if p[0] == p[1] else 0.0).otherwise(F.col(p)).alias(p) for p in PAIRS])


def curvature(edges: DataFrame, form: str = "share") -> DataFrame:
    """(id, curvature). share: least eigenvalue over their sum. spread: l1 - l2/l0 of the
    ascending eigenvalues. A neighbourhood without extent has curvature 0."""
    low, mid, high = spatial.eigenvalues(*[F.col(p) for p in PAIRS])
    value = {"share": F.try_divide(low, low + mid + high), "spread": mid - F.try_divide(high, low)}[form]
    return covariance(edges).select("id", F.coalesce(value, F.lit(0.0)).alias("curvature"))


def normals(edges: DataFrame) -> DataFrame:
    """(id, nx, ny, nz): eigenvector of the least eigenvalue, batched over Arrow; its sign
    makes the largest component positive."""
    import numpy as np

    @F.pandas_udf("nx double, ny double, nz double")
    def normal(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
        v = np.linalg.eigh(m)[1][:, :, 0] if len(m) else np.zeros((0, 3))
        big = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
        v = v * np.where(big < 0, -1.0, 1.0)
        return pd.DataFrame(v, columns=["nx", "ny", "nz"])

    return covariance(edges).select("id", normal(*PAIRS).alias("n")).select("id", "n.*")


def plane_fit(points: DataFrame) -> tuple[float, float, float, float]:
    """Least-squares plane (a, b, c, d) with ax + by + cz + d = 0: six sums in Spark, one
    3 x 3 eigenvector on the driver."""
    import numpy as np

    r = points.agg(*[F.avg(c).alias(c) for c in "xyz"], *[F.covar_pop(p[0], p[1]).alias(p) for p in PAIRS]).first()
    if r.x is None:
        raise ValueError("a plane needs points")
    m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
    n = np.linalg.eigh(m)[1][:, 0]
    return (*map(float, n), float(-n @ np.array([r.x, r.y, r.z])))


def resolution(points: DataFrame, least: float, most: float) -> DataFrame:
    """One row ``radius``: min(least * smallest, most * largest nearest-point distance)."""
    return neighbors.nearest_other(points).agg(F.least(F.min("d") * least, F.max("d") * most).alias("radius"))


def uniformity(points: DataFrame) -> DataFrame:
    """One row (variance, mean) of the nearest-point distances; population variance."""
    return neighbors.nearest_other(points).agg(F.var_pop("d").alias("variance"), F.avg("d").alias("mean"))


def density_select(points: DataFrame) -> DataFrame:
    """The points whose squared nearest-point distance exceeds the median."""
    d2 = neighbors.nearest_other(points).select("id", (F.col("d") * F.col("d")).alias("d2"))
    middle = d2.agg(F.percentile("d2", 0.5).alias("middle"))
    return points.join(d2, "id").crossJoin(F.broadcast(middle)).where("d2 > middle").drop("middle", "d2")


def bandwidth(points: DataFrame) -> DataFrame:
    """One row ``bandwidth``: the bounding box's longest side."""
    return points.agg(F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("bandwidth"))


def symmetric_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``distance``: the larger of the two RMS nearest-point distances."""
    one, two = neighbors.rms_distance(a, b), neighbors.rms_distance(b, a).withColumnRenamed("rms", "back")
    return one.crossJoin(two).select(F.greatest("rms", "back").alias("distance"))


def psnr(reference: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``psnr``: 10 log10 of squared bandwidth over squared symmetric distance."""
    both = bandwidth(reference).crossJoin(symmetric_distance(a, b))
    return both.select((10 * F.log10(F.try_divide(F.col("bandwidth") ** 2, F.col("distance") ** 2))).alias("psnr"))


def median_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``gap``: mean of the two exact medians of the nearest-point distances."""
    one = neighbors.cloud_distance(a, b).agg(F.percentile("d", 0.5).alias("p"))
    two = neighbors.cloud_distance(b, a).agg(F.percentile("d", 0.5).alias("q"))
    return one.crossJoin(two).select(((F.col("p") + F.col("q")) / 2).alias("gap"))


def outliers(points: DataFrame, k: int = 20, ratio: float = 5.0) -> DataFrame:
    """The points whose mean distance to their k nearest (self included) is at most the
    cloud's mean plus ``ratio`` sample deviations."""
    mean = neighbors.knn(points, k).groupBy(F.col("src").alias("id")).agg(F.avg(F.sqrt("d2")).alias("near"))
    limit = mean.agg((F.avg("near") + ratio * F.stddev_samp("near")).alias("limit"))
    kept = mean.crossJoin(F.broadcast(limit)).where("near <= limit or limit is null").select("id")
    return points.join(kept, "id", "left_semi")


