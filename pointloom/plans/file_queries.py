"""Queries over files that are made from the tables, read back and deleted."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import discard, shared_dir, stored
from ..operators import compose
from ..sources import files, formats
from .catalog import LPTS, PTS, lpts, pts, query, rounded

SCALE = 0.001


def _read_back(spark, suffix, write, read):
    """What ``read`` gives of the file or folder that ``write`` makes, which then goes."""
    path = f"{shared_dir(spark)}/cloud-{uuid.uuid4().hex}{suffix}"
    try:
        write(path)
        return stored(read(path), "read")
    finally:
        discard(spark, path)


def scan(spark, d):
    """The larger cloud as a scan: local coordinates, 16-bit colours, a class, an extra dimension."""
    p = lpts(spark, d)
    return p.select("id", *[(F.col(c) * 100).alias(c) for c in "xyz"], *[(F.col("id") * k % 65536).cast("int").alias(c) for k, c in ((1, "red"), (7, "green"), (31, "blue"))], (F.col("id") % 14).cast("int").alias("classification"), (F.col("id") % 2).cast("double").alias("Original cloud index"), F.col("id").cast("double").alias("key"))


SCAN = f"{LPTS}, scan AS (SELECT id, {', '.join(f'round_even({c}*100/{SCALE!r}::DOUBLE, 0)*{SCALE!r}::DOUBLE AS {c}' for c in 'xyz')}, (id % 65536)::INT AS red, (id*7 % 65536)::INT AS green, (id*31 % 65536)::INT AS blue, (id % 14)::INT AS classification, (id % 2)::DOUBLE AS cloud FROM lpts)"


@query(f"WITH {SCAN} SELECT row_number() OVER (ORDER BY id)-1 AS id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, red, green, blue, classification, cloud FROM scan")
def las_file(spark, d):
    """One file, written and merged by tasks, read in runs of records."""
    cloud = "Original cloud index"
    out = _read_back(spark, ".las", lambda p: files.write_las(scan(spark, d), p, SCALE, (cloud,)), lambda p: files.read_las(spark, p, (cloud,), run_bytes=1 << 18))
    return rounded(out.select("id", "x", "y", "z", "red", "green", "blue", "classification", F.col(cloud).alias("cloud")))


@query(f"WITH {SCAN} SELECT id::DOUBLE AS id, round(x, 6) AS x, {', '.join(f'round({c}/65535.0::DOUBLE, 6) AS {c[0]}' for c in ('red', 'green', 'blue'))} FROM scan WHERE classification = 3 AND x < 20.0")
def las_folder(spark, d):
    """A folder of files; the read decodes five columns, and its filters are pushed down."""
    formats.register(spark)

    def read(path):
        rows = spark.read.format("las").schema("key double, x double, y double, z double, red int, green int, blue int, classification int").load(path)
        return compose.project_rgb(rows.where("classification = 3 AND x < 20.0").withColumnRenamed("key", "id")).select("id", "x", "r", "g", "b")

    return rounded(_read_back(spark, "", lambda p: scan(spark, d).drop("id").write.format("las").option("scale", str(SCALE)).mode("append").save(p), read))


_SHADED = f"{PTS}, sh AS (SELECT id, x, y, z, {', '.join(f'(id % {m})/{m}.0::DOUBLE AS {c}' for c, m in zip('rgb', (97, 89, 83), strict=True))} FROM pts)"
_BYTES = ", ".join(f"round(round_even({c}*255, 0)/255, 6) AS {c}" for c in "rgb")


def shaded(spark, d):
    return pts(spark, d).select("id", "x", "y", "z", *[(F.col("id") % m / m).alias(c) for c, m in zip("rgb", (97, 89, 83), strict=True)])


@query(f"WITH {_SHADED} SELECT row_number() OVER (ORDER BY id)-1 AS id, round(x, 6)+0.0::DOUBLE AS x, round(y, 6)+0.0::DOUBLE AS y, round(z, 6)+0.0::DOUBLE AS z, {_BYTES} FROM sh")
def ply_file(spark, d):
    """One text file, read in runs of lines."""
    out = _read_back(spark, ".ply", lambda p: files.write_ply(shaded(spark, d), p), lambda p: files.read_ply(spark, p, 1 << 14))
    return rounded(out.select("id", "x", "y", "z", "r", "g", "b"))


@query(f"WITH {_SHADED} SELECT id::DOUBLE AS id, round(z, 6)+0.0::DOUBLE AS z, {_BYTES} FROM sh WHERE z > 0")
def ply_folder(spark, d):
    """Binary files with a property of its own; two coordinates are never decoded."""
    formats.register(spark)
    out = _read_back(spark, "", lambda p: shaded(spark, d).withColumn("key", F.col("id").cast("double")).drop("id").write.format("ply").mode("append").save(p), lambda p: spark.read.format("ply").schema("key double, z double, r double, g double, b double").load(p).where("z > 0"))
    return rounded(out.withColumnRenamed("key", "id"))


@query(f"WITH {_SHADED} SELECT 'first.ply' AS name, count(*) AS n FROM sh WHERE id % 2 = 0 UNION ALL SELECT 'second.ply', count(*) FROM sh WHERE id % 2 = 1")
def ply_pair(spark, d):
    """Two clouds of a pair in one folder, counted by their names."""
    p = shaded(spark, d)
    out = _read_back(spark, "", lambda f: files.write_ply_pair(p.where("id % 2 = 0"), p.where("id % 2 = 1"), f, ("first.ply", "second.ply")), lambda f: files.read_ply(spark, f).groupBy(F.substring_index("file", "/", -1).alias("name")).agg(F.count(F.lit(1)).alias("n")))
    return out
