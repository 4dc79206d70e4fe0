"""Clouds over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from the first three embedding elements, with class and cloud number."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")], F.col("label").alias("cls"), (F.col("vec_id") % 2).cast("int").alias("cloud"))


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("feature"), (F.col("vec_id") % 2).cast("int").alias("cloud"))


def lpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger cloud from orders, each axis scaled to about [0, 1]."""
    o = table(spark, sf_dir, "orders")
    top = o.agg(F.max("o_custkey").alias("top"))
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return o.crossJoin(F.broadcast(top)).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000 / 500).alias("x"), (F.col("o_custkey") / F.col("top")).alias("y"), (days / 2404).alias("z"))
