"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The steps written within each open ``scratch`` of the driver, the innermost last.
_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one, else the checkpoint folder in
    force. Only a local master, whose tasks all see the driver's disk, gets a temporary
    folder; on a cluster a missing folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is executed inside go when it is done, not when the driver's
    JVM happens to collect the plan. (Spark keeps them for a frame that is executed again; it
    would make them anew.)"""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, what: str = "step", files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from files that
    outlive any executor. ``files``: as many at most, for tables of a known small size. No
    success marker is written, as the caller waits for the job; its shuffle files go at its end."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    out = df if files is None else df.coalesce(max(1, files))
    with swept(df.sparkSession):
        out.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    if _written:
        _written[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete steps that no later plan reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Steps written inside are deleted at the end, but for those whose frames (as
    ``stored`` returned them) are put in the list, which an enclosing ``scratch`` takes over."""
    kept: list[DataFrame] = []
    _written.append([])
    try:
        yield kept
    finally:
        held, stay = _written.pop(), {getattr(df, "_stored_at", None) for df in kept}
        discard(spark, *(p for p in held if p not in stay))
        if _written:
            _written[-1].extend(p for p in held if p in stay)


@contextmanager
def bucketed(df: DataFrame, columns: list[str], what: str = "held") -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, bucketed by ``columns`` into as many buckets as
    a shuffle has partitions: joins and groups on these columns read it where it lies, as
    often as they like. The table goes at the end."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    path, parts = f"{shared_dir(spark)}/{name}", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        df.repartition(parts, *columns).write.option("path", path).bucketBy(parts, *columns).sortBy(*columns).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, path)
