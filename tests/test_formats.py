"""PLY and LAS as data sources: splitting, pruning, pushdown, committed writes, whole files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.sources import files, formats


def cloud(spark, n, parts=5):
    return spark.range(n).repartition(parts).select("id", (F.col("id") / 8).alias("x"), (-F.col("id") / 4).alias("y"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") % 65536).cast("int").alias("red"), F.lit(3).alias("green"), F.lit(None).cast("int").alias("blue"), (F.col("id") % 5).cast("int").alias("classification"), (F.col("id") * 1.5).alias("Constant"))


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("file", "id").select(*cols).collect()]


def test_las_splits_into_runs(spark, tmp_path):
    files.write_las(cloud(spark, 3000), str(tmp_path / "a.las"), extra=("Constant",))
    whole = files.read_las(spark, str(tmp_path / "a.las"), ("Constant", "absent"))
    split = files.read_las(spark, f"file://{tmp_path}/*.las", ("Constant", "absent"), run_bytes=34 * 101)
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() == 30
    want = [(k, k / 8, -k / 4, k % 7, k % 5, k, 3, 0, k * 1.5, None) for k in range(3000)]
    cols = ("id", "x", "y", "z", "classification", "red", "green", "blue", "Constant", "absent")
    assert rows(whole, *cols) == rows(split, *cols) == want
    assert (tmp_path / "a.las").stat().st_size == 227 + 54 + 192 + 3000 * 34  # one header


def test_only_asked_columns_are_decoded(spark, tmp_path):
    files.write_las(cloud(spark, 50), str(tmp_path / "a.las"))
    formats.register(spark)
    got = spark.read.format("las").schema("red int, y double").load(str(tmp_path / "a.las"))
    assert got.columns == ["red", "y"] and sorted(map(tuple, got.collect())) == [(k, -k / 4) for k in range(50)]
    layout = formats.las_layout(lambda n, at: (tmp_path / "a.las").read_bytes()[at : at + n], 10**6)
    assert set(formats.decoded(layout, bytes(26), ["red"])) == {"red"}


def test_filters_are_pushed_down(spark, tmp_path):
    formats.register(spark)
    for k in range(4):
        files.write_las(cloud(spark, 100).withColumn("x", F.col("x") + 1000 * k), str(tmp_path / f"{k}.las"))
    reader = formats.Reader(spark.read.format("las").load(str(tmp_path)).schema, {"path": str(tmp_path)}, ".las", formats.las_layout)
    asked = [formats.GreaterThan(("x",), 1005.0), formats.LessThan(("x",), 1999.0), formats.In(("red",), (50, 60)), formats.LessThanOrEqual(("id",), 70)]
    assert list(reader.pushFilters(asked)) == asked  # Spark applies them again
    (run,) = reader.partitions()
    assert run.uri.endswith("1.las") and sum(b.num_rows for b in reader.read(run)) == 2
    got = spark.read.format("las").load(str(tmp_path)).where("x > 1005 AND x < 1999 AND red IN (50, 60)")
    assert sorted(r.red for r in got.collect()) == [50, 60]
    assert spark.read.format("las").load(str(tmp_path)).where("x IS NULL OR z = 3").count() == 4 * 14
    plain = spark.read.format("las").load(str(tmp_path))
    for rule in ("id = 7", "id >= 95 AND y < -24", "blue IS NOT NULL", "red > 1e9", "classification <=> 2"):
        assert plain.where(rule).count() == sum(1 for _ in filter(None, (r[0] for r in plain.select(F.expr(f"coalesce({rule}, false)")).collect())))


def test_folder_is_committed_once(spark, tmp_path):
    """Parts have headers of their own; overwriting replaces them; a failed job leaves nothing."""
    formats.register(spark)
    out = f"file://{tmp_path}/out"
    cloud(spark, 1000, 4).write.format("las").mode("append").save(out)
    names = sorted(f.name for f in (tmp_path / "out").iterdir())
    assert len(names) == 4 and all(n.startswith("part-") for n in names)
    assert sorted(r.red for r in spark.read.format("las").load(out).collect()) == list(range(1000))
    cloud(spark, 10, 1).write.format("las").mode("append").save(out)
    assert spark.read.format("las").load(out).count() == 1010
    cloud(spark, 20, 2).write.format("las").mode("overwrite").save(out)
    assert spark.read.format("las").load(out).count() == 20
    broken = cloud(spark, 1000, 4).withColumn("x", F.when(F.col("id") == 999, 1e30).otherwise(F.col("x")))
    with pytest.raises(Exception, match="too far out"):
        broken.write.format("las").mode("append").save(out)
    assert spark.read.format("las").load(out).count() == 20
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_")]


def test_second_attempt_leaves_one_copy(tmp_path):
    """What a task wrote before it failed isn't moved: only the accepted attempt's names are."""
    import pyarrow as pa
    from pyspark import TaskContext

    class Task:
        def partitionId(self):  # noqa: N802
            return 3

    held, TaskContext.get = TaskContext.get, staticmethod(Task)
    try:
        writer = formats.Writer(None, {"path": str(tmp_path / "out")}, False, ".ply", formats.ply_packed)
        batch = pa.RecordBatch.from_pydict({c: [1.0, 2.0] for c in "xyz"})
        writer.write(iter([batch]))
        second = writer.write(iter([batch]))
    finally:
        TaskContext.get = held
    writer.commit([second, None])
    assert len(list((tmp_path / "out").iterdir())) == 1


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian"])
def test_ply_folder(spark, tmp_path, form):
    formats.register(spark)
    p = cloud(spark, 500).select("id", "x", "y", "z", (F.col("red") / 500).alias("r"), F.lit(0.5).alias("g"), F.lit(None).cast("double").alias("b"), F.col("Constant").alias("w"))
    p.write.format("ply").option("form", form).mode("append").save(str(tmp_path / "out"))
    got = spark.read.format("ply").schema("file string, id long, x double, r double, g double, b double, nx double, w double").load(str(tmp_path / "out"))
    want = sorted((k / 8, round(k / 500 * 255) / 255, 128 / 255, 0.0, None, k * 1.5) for k in range(500))
    assert sorted((r.x, r.r, r.g, r.b, r.nx, r.w) for r in got.collect()) == want


@pytest.mark.parametrize("run_bytes", [7, 64, 1000, 1 << 20])
def test_text_ply_splits_at_lines(spark, tmp_path, run_bytes):
    """Lines of any length, line ends of both kinds, faces behind the vertices, no last end."""
    rng = np.random.default_rng(1)
    points = [(float(k), *(10.0 ** rng.integers(-9, 9, 2)).tolist()) for k in range(200)]
    for name, end, tail in (("a", "\n", "\n3 0 1 2\n3 1 2 3\n"), ("b", "\r\n", ""), ("c", "\n", "\n")):
        head = f"ply{end}format ascii 1.0{end}comment x{end}element vertex 200{end}property double x{end}property double y{end}property double z{end}element face 2{end}property list uchar int vertex_indices{end}end_header{end}"
        (tmp_path / f"{name}.ply").write_bytes((head + end.join(" ".join(map(repr, p)) for p in points) + tail).encode())
    got = files.read_ply(spark, str(tmp_path), run_bytes)
    assert rows(got, "id", "x", "y", "z") == [(k, *p) for _ in range(3) for k, p in enumerate(points)]
    if run_bytes < 100:
        assert got.rdd.getNumPartitions() > 30


def test_binary_ply_splits(spark, tmp_path):
    """Big-endian records with 16-bit colours behind an element of one length."""
    kind = np.dtype([("x", ">f4"), ("y", ">f8"), ("z", ">i2"), ("red", ">u2"), ("nx", ">f4")])
    data = np.zeros(1000, kind)
    data["x"], data["y"], data["z"], data["red"], data["nx"] = np.arange(1000), np.arange(1000) / 7, np.arange(1000) % 100 - 50, np.arange(1000), 0.25
    head = "ply\nformat binary_big_endian 1.0\nelement camera 2\nproperty float f\nproperty uchar k\nelement vertex 1000\nproperty float x\nproperty double y\nproperty short z\nproperty ushort red\nproperty float nx\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head.encode() + bytes(10) + data.tobytes() + b"rest")
    got = files.read_ply(spark, str(tmp_path / "a.ply"), 20 * 33)
    assert got.rdd.getNumPartitions() == 31
    assert rows(got, "id", "x", "y", "z", "r", "g", "nx") == [(k, float(k), k / 7, k % 100 - 50.0, k / 65535, None, 0.25) for k in range(1000)]


def test_las_14_and_broken_files(spark, tmp_path):
    """A 64-bit count, point format 7 and offsets; short and foreign files are errors."""
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<H", head, 94, 375)
    struct.pack_into("<IIBHI", head, 96, 375, 0, 7, 36, 0)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 300.0)
    struct.pack_into("<6d", head, 179, 102.0, 100.0, 200.0, 200.0, 300.0, 300.0)
    struct.pack_into("<Q", head, 247, 3)
    body = b"".join(struct.pack("<iii", 100 * k, 0, 0) + bytes(4) + bytes([9 + k]) + bytes(13) + struct.pack("<HHH", k, 2, 3) for k in range(3))
    (tmp_path / "a.las").write_bytes(bytes(head) + body)
    got = files.read_las(spark, str(tmp_path / "a.las"))
    assert rows(got, "id", "x", "classification", "red", "blue") == [(k, float(k), 9 + k, k, 3) for k in range(3)]
    assert rows(files.read_las(spark, str(tmp_path / "a.las"), keep_offset=True), "x", "y") == [(100.0 + k, 200.0) for k in range(3)]
    assert files.read_las(spark, str(tmp_path / "a.las")).where("x > 1.5").count() == 1
    assert files.read_las(spark, str(tmp_path / "a.las"), keep_offset=True).where("x > 101.5").count() == 1
    (tmp_path / "b.las").write_bytes(bytes(head) + body[:50])
    with pytest.raises(Exception, match="shorter"):
        files.read_las(spark, str(tmp_path / "b.las")).count()
    (tmp_path / "c.ply").write_bytes(b"no ply at all")
    with pytest.raises(Exception, match="not a PLY"):
        files.read_ply(spark, str(tmp_path / "c.ply")).count()
    with pytest.raises(FileNotFoundError):
        files.read_ply(spark, str(tmp_path / "d.ply")).count()


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.6 GB: many tasks, only the asked runs and columns."""
    n = 100_000_000
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<IIBHI", head, 96, 227, 0, 2, 26, n)
    struct.pack_into("<3d", head, 131, 1.0, 1.0, 1.0)
    with open(tmp_path / "big.las", "wb") as f:
        f.write(head)
        f.truncate(227 + 26 * n)
        f.seek(227 + 26 * (n - 1))
        f.write(struct.pack("<iii", 5, 6, 7) + bytes(14))
    formats.register(spark)
    got = spark.read.format("las").schema("id long, x double").load(str(tmp_path / "big.las"))
    assert got.rdd.getNumPartitions() == -(-26 * n // ((64 << 20) // 26 * 26))
    assert [tuple(r) for r in got.where(f"id >= {n - 2}").collect()] == [(n - 2, 0.0), (n - 1, 5.0)]
