"""PLY and LAS files, matrices and seeds as text, directory scans.

Clouds are read through the data sources of :mod:`formats`, which split files. Where only
Spark can open a path, its ``binaryFile`` source reads each file as one row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats

#: Rows of a record batch.
ROWS = 100_000


def scan_folder(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, name, length) of the files below a folder with a suffix; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length")


def _columns(layout: formats.Layout, data: bytes) -> dict[str, np.ndarray]:
    names = list(layout.fields)
    if layout.length:
        return formats.decoded(layout, data[layout.start : layout.start + layout.count * layout.length], names)
    return formats.parsed(layout, data[layout.start :].split(b"\n")[: layout.count], names)


def ply_vertices(data: bytes) -> dict[str, np.ndarray]:
    """The vertex columns of an ASCII or binary PLY file."""
    layout = formats.ply_layout(lambda n, at: data[at : at + n], len(data))
    return {c: v.astype(float) for c, v in _columns(layout, data).items()}


def _batches(columns: dict[str, np.ndarray], path: str) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values()))) if columns else 0
    for at in range(0, n, ROWS):
        part = {k: v[at : at + ROWS] for k, v in columns.items()}
        size = len(next(iter(part.values())))
        yield pa.RecordBatch.from_pydict({"file": pa.array([path] * size), **{k: pa.array(v) for k, v in part.items()}})


def _opens(path: str) -> bool:
    """Whether tasks can open the path themselves."""
    try:
        formats.located(path)
    except (ValueError, OSError, pa.ArrowException):
        return False
    return True


PLY_COLUMNS = ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")


def read_ply(spark: SparkSession, path: str, run_bytes: int = formats.RUN_BYTES) -> DataFrame:
    """(file, id, x, y, z, r, g, b, nx, ny, nz): ids follow the file order; 8- and 16-bit
    colours are scaled to [0, 1]; absent properties are null. ``path`` is a file, a folder or
    a pattern. Files are read in runs of ``run_bytes``; of text files a first pass counts the
    lines of each run."""
    if _opens(path):
        formats.register(spark)
        bases = formats.line_bases(spark, path, run_bytes)
        return spark.read.format("ply").option("runbytes", run_bytes).option("bases", json.dumps(bases)).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = ply_vertices(data)
                n = len(v["x"])
                held = {"id": np.arange(n), **{c: v.get(c, np.full(n, np.nan)) for c in PLY_COLUMNS}}
                yield from _batches(held, name)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(run, "file string, id long, " + ", ".join(f"{c} double" for c in PLY_COLUMNS))
    return out.select("file", "id", "x", "y", "z", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in PLY_COLUMNS[3:]])


def write_ply(points: DataFrame, path: str) -> None:
    """One ASCII PLY file, rows in order of id (colours are written where the cloud has them,
    null ones as 0). Tasks write and merge the lines; the path must lie in a mounted file
    system. ``df.write.format("ply")`` writes a folder anywhere."""
    colored = {"r", "g", "b"} <= set(points.columns)
    formats.saved(points.select("id", *"xyz", *("rgb" if colored else "")), path, "ply", form="ascii")


def write_ply_pair(a: DataFrame, b: DataFrame, folder: str, names: tuple[str, str]) -> None:
    write_ply(a, f"{folder}/{names[0]}")
    write_ply(b, f"{folder}/{names[1]}")


def las_columns(data: bytes, extra: tuple[str, ...] = (), keep_offset: bool = False) -> dict[str, np.ndarray]:
    """x, y, z, classification, red, green, blue and the named extra dimensions of LAS 1.2 to
    1.4. Offsets are dropped unless asked for, so coordinates are local."""
    layout = formats.las_layout(lambda n, at: data[at : at + n], len(data), keep_offset)
    wanted = ("x", "y", "z", "classification", "red", "green", "blue", *extra)
    return {c: v for c, v in _columns(layout, data).items() if c in wanted}


def read_las(spark: SparkSession, path: str, extra: tuple[str, ...] = (), keep_offset: bool = False, run_bytes: int = formats.RUN_BYTES) -> DataFrame:
    """(file, id, x, y, z, classification, red, green, blue, extra ...): ids follow the file
    order; files without colours, and extra dimensions that a file hasn't, have nulls. Files
    are read in runs of ``run_bytes``."""
    schema = "file string, id long, x double, y double, z double, classification int, red int, green int, blue int" + "".join(f", `{c}` double" for c in extra)
    if _opens(path):
        formats.register(spark)
        return spark.read.format("las").schema(schema).option("runbytes", run_bytes).option("keepoffset", str(keep_offset).lower()).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = las_columns(data, extra, keep_offset)
                n = len(v["x"])
                held = {"id": np.arange(n), **{c: v[c] for c in "xyz"}, "classification": v["classification"].astype(np.int32)}
                for c in ("red", "green", "blue"):
                    held[c] = v[c].astype(np.int32) if c in v else np.full(n, -1, np.int32)
                held |= {c: v[c].astype(float) if c in v else np.full(n, np.nan) for c in extra}
                yield from _batches(held, name)

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    return out.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("red", "green", "blue")})


def write_las(points: DataFrame, path: str, scale: float = 0.001, extra: tuple[str, ...] = ()) -> None:
    """One LAS 1.2 file, point format 2: x, y, z and 16-bit red, green, blue (null: 0),
    optional classification, named extra dimensions as doubles; rows in order of id. Clouds
    beyond the format's 32-bit count or 32-bit coordinates, and null coordinates, are errors.
    Tasks write and merge the records; the path must lie in a mounted file system.
    ``df.write.format("las")`` writes a folder anywhere."""
    cols = ["id", *"xyz", "red", "green", "blue", *(["classification"] if "classification" in points.columns else []), *extra]
    span = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.count, F.min, F.max)]).first()
    ends = [span[f"{f}_{c}"] or 0.0 for c in "xyz" for f in ("max", "min")]
    if any(span[f"count_{c}"] < span["n"] for c in "xyz"):
        raise ValueError("null coordinates")
    if span["n"] >= 2**32 or not all(abs(v) / scale < 2**31 - 1 for v in ends):
        raise ValueError("too many points or too far out for this scale")
    formats.saved(points.select(*[F.col(f"`{c}`") for c in cols]), path, "las", scale=str(scale))


def read_matrix(spark: SparkSession, path: str) -> list[list[list[float]]]:
    """The 4 x 4 matrices stacked in a whitespace-separated text file."""
    text = spark.read.text(path, wholetext=True).first()[0]
    rows = [[float(v) for v in re.split(r"[\s,]+", line.strip())] for line in text.splitlines() if line.strip()]
    if len(rows) % 4 or any(len(r) != 4 for r in rows):
        raise ValueError("expected rows of four numbers, four to a matrix")
    return [rows[k : k + 4] for k in range(0, len(rows), 4)]


def write_matrix(path: str, *matrices: list[list[float]]) -> None:
    with open(path, "w", encoding="ascii") as f:
        for m in matrices:
            f.writelines(" ".join(repr(float(v)) for v in r) + "\n" for r in m)


def write_seed(path: str, seed: int) -> None:
    with open(path, "w", encoding="ascii") as f:
        f.write(f"{seed}\n")
