"""Shared helpers: table access, partitions, what a worker keeps."""

from __future__ import annotations

import builtins
import pickle
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import scratch, stored

__all__ = ["columns", "in_batches", "opened", "per_worker", "scratch", "share", "spread", "stored", "table", "unused", "whole"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark only (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the scan gives fewer partitions than there are cores (small
    inputs in one file); larger inputs keep their scan partitions and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def whole(text: str | Column) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def in_batches(rows: Iterator, max_rows: int) -> Iterator:
    """Cut Arrow record batches to at most ``max_rows`` rows."""
    for batch in rows:
        for at in range(0, batch.num_rows, max_rows):
            yield batch.slice(at, max_rows)


def per_worker(name: str, spec: str, make: Callable[[str], Any]) -> Any:
    """``make(spec)``, kept for the later tasks of this Python worker (the latest per name)."""
    kept = builtins.__dict__.setdefault("_kept_per_worker", {})
    digest = sha256(spec.encode()).digest()
    if kept.get(name, (None,))[0] != digest:
        kept.pop(name, None)
        kept[name] = (digest, make(spec))
    return kept[name][1]


def share(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast an object of this package by value, class and all."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(held: Broadcast) -> Any:
    """The shared object, unpickled once for all batches of a task."""
    if "_opened" not in held.__dict__:
        held._opened = pickle.loads(held.value)
    return held._opened
