"""Surface samples of simple shapes, generated in parallel.

Without a seed the points follow low-discrepancy sequences and are a function of their
number alone; with a seed they are uniform random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps of the low-discrepancy sequence (powers of the plastic number's inverse).
STEPS = (0.7548776662466927, 0.5698402909980532)


def _uniform(k: int, seed: int | None) -> Column:
    if seed is None:
        v = (F.col("id") + 0.5) * STEPS[k]
        return v - F.floor(v)
    return F.rand(seed + k)


def sphere(spark: SparkSession, n: int, radius: float = 10.0, seed: int | None = None) -> DataFrame:
    z = F.lit(1.0) - F.lit(2.0) * _uniform(0, seed)
    turn = F.lit(2 * math.pi) * _uniform(1, seed)
    flat = spark.range(n).select("id", z.alias("h"), turn.alias("a"))
    ring = F.sqrt(F.greatest(1 - F.col("h") * F.col("h"), F.lit(0.0)))
    return flat.select("id", (radius * ring * F.cos("a")).alias("x"), (radius * ring * F.sin("a")).alias("y"), (radius * F.col("h")).alias("z"))


def box(spark: SparkSession, n: int, size: float = 10.0, seed: int | None = None) -> DataFrame:
    u, v, face = _uniform(0, seed) * size, _uniform(1, seed) * size, F.col("id") % 6
    flat = spark.range(n).select("id", u.alias("u"), v.alias("v"), face.alias("f"))
    side = F.when(F.col("f") % 2 == 0, 0.0).otherwise(float(size))
    axis = F.floor(F.col("f") / 2)
    return flat.select("id", F.when(axis == 0, side).otherwise(F.col("u")).alias("x"), F.when(axis == 1, side).when(axis == 0, F.col("u")).otherwise(F.col("v")).alias("y"), F.when(axis == 2, side).otherwise(F.col("v")).alias("z"))


def cylinder(spark: SparkSession, n: int, radius: float = 10.0, height: float = 30.0, seed: int | None = None) -> DataFrame:
    """Sides and both caps, in proportion to their areas."""
    side = height / (height + radius)
    flat = spark.range(n).select("id", _uniform(0, seed).alias("u"), (2 * math.pi * _uniform(1, seed)).alias("a"))
    on_side, rest = F.col("u") < side, (F.col("u") - side) / (1 - side)
    ring = F.when(on_side, float(radius)).otherwise(radius * F.sqrt(rest * 2 - F.floor(rest * 2)))
    z = F.when(on_side, (F.col("u") / side - 0.5) * height).when(rest < 0.5, -height / 2).otherwise(height / 2)
    return flat.select("id", (ring * F.cos("a")).alias("x"), (ring * F.sin("a")).alias("y"), z.alias("z"))


def cone(spark: SparkSession, n: int, radius: float = 10.0, height: float = 30.0, seed: int | None = None) -> DataFrame:
    """Side and base, in proportion to their areas; the apex is up."""
    slant = math.hypot(radius, height)
    side = slant / (slant + radius)
    flat = spark.range(n).select("id", _uniform(0, seed).alias("u"), (2 * math.pi * _uniform(1, seed)).alias("a"))
    on_side = F.col("u") < side
    share = F.sqrt(F.when(on_side, F.col("u") / side).otherwise((F.col("u") - side) / (1 - side)))
    return flat.select("id", (radius * share * F.cos("a")).alias("x"), (radius * share * F.sin("a")).alias("y"), F.when(on_side, height * (1 - share)).otherwise(0.0).alias("z"))
