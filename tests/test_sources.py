"""Files, shapes and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.sources import files, shapes
from pointloom.streaming import voxels


def test_ply_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.5, -1.25, 3.0, 0.0, 1.0, 0.2), (0, 1e-9, 2.0, 3.5, 1.0, 0.0, 0.4)], "id long, x double, y double, z double, r double, g double, b double")
    files.write_ply(p, str(tmp_path / "a" / "c.ply"))
    got = files.read_ply(spark, str(tmp_path / "a")).orderBy("id").collect()
    assert [(r.id, r.x, r.y, r.z) for r in got] == [(0, 1e-9, 2.0, 3.5), (1, 0.5, -1.25, 3.0)]
    assert got[0].r == 1.0 and got[0].nx is None


def test_binary_ply():
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty double z\nend_header\n"
    rows = np.array([(1, 2, 3), (4, 5, 6)], dtype=[("x", "<f4"), ("y", "<f4"), ("z", "<f8")]).tobytes()
    v = files.ply_vertices(head + rows)
    assert v["z"].tolist() == [3.0, 6.0]


def test_las_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0, 1.5, 2.25, -3.125, 65535, 0, 7, 4)], "id long, x double, y double, z double, red int, green int, blue int, classification int")
    files.write_las(p, str(tmp_path / "s_8212.las"))
    r = files.read_las(spark, str(tmp_path / "*.las"), extra=("Constant",)).first()
    assert (r.x, r.y, r.z, r.red, r.green, r.blue, r.classification, r.Constant) == (1.5, 2.25, -3.125, 65535, 0, 7, 4, None) or np.isnan(r.Constant)
    assert files.scan_folder(spark, str(tmp_path), ".las").select("name").first()[0] == "s_8212.las"


def test_writers_pack_all_ranges(spark, tmp_path):
    """Many ranges of ids, null colours, an empty cloud, coordinates that don't fit."""
    p = spark.range(5000).repartition(7).select("id", (F.col("id") / 8).alias("x"), (-F.col("id") / 4).alias("y"), F.lit(0.0).alias("z"), *[F.when(F.col("id") % 2 == 0, F.col("id")).cast("int").alias(c) for c in ("red", "green", "blue")])
    files.write_las(p, str(tmp_path / "a.las"))
    got = files.read_las(spark, str(tmp_path / "a.las")).orderBy("id").collect()
    assert [(r.x, r.y, r.red) for r in got] == [(k / 8, -k / 4, k if k % 2 == 0 else 0) for k in range(5000)]
    assert np.frombuffer((tmp_path / "a.las").read_bytes(), "<f8", 6, 179).tolist() == [4999 / 8, 0.0, 0.0, -4999 / 4, 0.0, 0.0]
    shade = [(F.col("red") / 5000).alias(c) for c in "rgb"]
    files.write_ply(p.select("id", "x", "y", "z", *shade), str(tmp_path / "p" / "a.ply"))
    got = files.read_ply(spark, str(tmp_path / "p")).orderBy("id").collect()
    assert [(r.x, r.y, r.r) for r in got] == [(k / 8, -k / 4, round(k / 5000 * 255) / 255 if k % 2 == 0 else 0.0) for k in range(5000)]
    files.write_las(p.limit(0), str(tmp_path / "b.las"))
    assert files.read_las(spark, str(tmp_path / "b.las")).count() == 0
    with pytest.raises(ValueError):
        files.write_las(p.withColumn("x", F.lit(1e9)), str(tmp_path / "c.las"))
    with pytest.raises(ValueError):
        files.write_las(p.withColumn("x", F.lit(None).cast("double")), str(tmp_path / "c.las"))


def test_matrix_and_seed(spark, tmp_path):
    m = [[1.0, 0.0, 0.0, 0.5], [0.0, 1.0, 0.0, -2.0], [0.0, 0.0, 1.0, 1e-12], [0.0, 0.0, 0.0, 1.0]]
    files.write_matrix(str(tmp_path / "t.txt"), m, m)
    assert files.read_matrix(spark, str(tmp_path / "t.txt")) == [m, m]
    files.write_seed(str(tmp_path / "seeds.txt"), 42)
    assert (tmp_path / "seeds.txt").read_text() == "42\n"


@pytest.mark.parametrize("seed", [None, 3])
def test_shapes_lie_on_their_surfaces(spark, seed):
    s = shapes.sphere(spark, 500, 10, seed)
    assert s.where(F.abs(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - 10) > 1e-9).count() == 0
    b = shapes.box(spark, 600, 10, seed)
    assert b.where("x in (0, 10) or y in (0, 10) or z in (0, 10)").count() == 600
    c = shapes.cylinder(spark, 500, 10, 30, seed)
    assert c.where("abs(z) > 15 or (abs(z) < 15 and abs(sqrt(x*x + y*y) - 10) > 1e-9)").count() == 0
    k = shapes.cone(spark, 500, 10, 30, seed)
    assert k.where("z <> 0 and abs(sqrt(x*x + y*y) - 10 * (1 - z / 30)) > 1e-9").count() == 0


def test_streamed_voxels(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).select(F.col("id"), (F.col("id") % 10 / 10).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).write.parquet(src)
    stream = spark.readStream.schema("id long, x double, y double, z double").parquet(src)
    q = voxels.voxel_means(stream, 0.5).writeStream.outputMode("complete").format("memory").queryName("vox").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.cx, r.n) for r in spark.table("vox").collect()} == {(0, 50), (1, 50)}
