"""Iterations over a graph whose edges don't move.

The points are cut along a space-filling curve into blocks of bounded size. A block's part of
the matrix (its points' rows), and the lists of what it needs from other blocks and they from
it, are written once as a table bucketed by block, so that a step reads them where they lie.
A step exchanges the state: each block's own values, and those at its border that other
blocks need. Steps are plain numpy within a block; several of them form one job.

``times`` needs the neighbours' values (gather); ``transposed`` makes contributions to the
neighbours (scatter), so rows that many points refer to never meet in one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import scratch, shared_dir, stored, swept
from . import sampling

#: Points of a block.
SIZE = 4096
#: Kinds of rows that a step exchanges: a block's own values, those that a neighbour needs,
#: and contributions to a neighbour's points.
OWN, GATHER, SCATTER = 0, 1, 2
_ROWS = "block long, origin long, kind int, v array<double>"


@dataclass
class Block:
    """One block: ``data`` has a column per value of its points; edges are (row, col, w) with
    columns from ``n`` on standing for the border points of other blocks, in ``halo`` order.
    ``halo`` lists (block, how many of its points), ``sends`` (block, own points it needs)."""

    name: int
    data: dict[str, np.ndarray]
    row: np.ndarray
    col: np.ndarray
    w: np.ndarray
    halo: list[tuple[int, int]]
    sends: list[tuple[int, np.ndarray]]
    kept: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        return len(self.data["id"])

    @property
    def alone(self) -> bool:
        return not self.halo and not self.sends

    def _summed(self, key: str, by: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        """Rows of ``values`` (in the order of :meth:`_order`) summed by ``by``."""
        out = np.zeros((size, values.shape[1]))
        if len(by):
            first = self.kept.setdefault(f"first {key}", np.flatnonzero(np.diff(by, prepend=-1)))
            out[by[first]] = np.add.reduceat(values, first, axis=0)
        return out

    def _order(self, key: str, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if key not in self.kept:
            order = np.argsort(by, kind="stable")
            self.kept[key] = (by[order], self.row[order], self.col[order], self.w[order][:, None])
        return self.kept[key]

    def times(self, own: np.ndarray, border: np.ndarray) -> np.ndarray:
        """W x at the block's points, from its own and its border's values."""
        by, _, col, w = self._order("row", self.row)
        return self._summed("row", by, w * np.concatenate([own, border])[col], self.n)

    def transposed(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block's share of W'x at its own points and at its border's."""
        by, row, _, w = self._order("col", self.col)
        out = self._summed("col", by, w * own[row], self.n + sum(k for _, k in self.halo))
        return out[: self.n], out[self.n :]


@dataclass
class Inbox:
    """What a block has got: its state, its border's values, contributions summed by point."""

    own: np.ndarray
    border: np.ndarray
    given: np.ndarray


@dataclass
class Outbox:
    """What it sends: the next state, values that neighbours may need (a row per own point),
    contributions (a row per border point)."""

    own: np.ndarray
    gather: np.ndarray | None = None
    scatter: np.ndarray | None = None


def curve(points: DataFrame, bits: int = 16) -> Column:
    """The place of a point on a space-filling curve over the cloud's box (null coordinates
    lie at its lower end)."""
    ends = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)]).first()
    out = F.lit(0).cast("long")
    for k, c in enumerate("xyz"):
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        if low is None or not high > low:
            continue
        step = F.least(F.floor((F.coalesce(F.col(c), F.lit(low)) - F.lit(low)) / F.lit((high - low) / 2**bits)), F.lit(2**bits - 1)).cast("long")
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(step, b).bitwiseAND(F.lit(1).cast("long")), 3 * b + k))
    return out


class Graph:
    """Blocks of a cloud and of the rows of a matrix over it.

    ``points`` has id, x, y, z and the ``columns`` that steps need (doubles); ``edges`` has
    src, dst, w with few rows per src. Ends that aren't points are left out. Ids are unique
    and not null. ``sizes`` bounds a block's points."""

    def __init__(self, points: DataFrame, edges: DataFrame, columns: tuple[str, ...] = (), size: int | None = None):
        self.spark, self.columns, size = points.sparkSession, columns, size or SIZE
        with scratch(self.spark):
            placed = points.select("id", *dict.fromkeys(("x", "y", "z", *columns))).withColumn("place", curve(points))
            ranked = sampling.running(placed, [F.asc("place"), F.asc("id")]).withColumn("r", F.col("rank_") - 1)
            at = stored(ranked.select("id", F.floor(F.col("r") / size).alias("block"), (F.col("r") % size).cast("int").alias("slot"), *[F.col(c).cast("double").alias(c) for c in columns]), "places")
            self.count = at.count()
            # no more partitions than blocks
            self.parts = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.count // size)))
            side = lambda k, b, s: at.select(F.col("id").alias(k), F.col("block").alias(b), F.col("slot").alias(s))
            met = stored(edges.select("src", "dst", F.col("w").cast("double").alias("w")).join(side("src", "sb", "ss"), "src").join(side("dst", "db", "ds"), "dst").select("sb", "ss", "db", "ds", "w"), "edges")
            none, nothing = F.lit(None).cast("double"), F.array().cast("array<double>")
            points_ = at.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("other"), F.col("slot").alias("a"), F.lit(0).alias("b"), none.alias("w"), "id", F.array(*[F.col(c) for c in columns]).cast("array<double>").alias("held"))
            edges_ = met.select(F.col("sb").alias("block"), F.lit(1).alias("kind"), F.col("db").alias("other"), F.col("ss").alias("a"), F.col("ds").alias("b"), "w", F.lit(None).cast("long").alias("id"), nothing.alias("held"))
            sends_ = met.where("sb <> db").select("db", "sb", "ds").distinct().select(F.col("db").alias("block"), F.lit(2).alias("kind"), F.col("sb").alias("other"), F.col("ds").alias("a"), F.lit(0).alias("b"), none.alias("w"), F.lit(None).cast("long").alias("id"), nothing.alias("held"))
            self.whole = met.where("sb <> db").isEmpty()  # no block needs another
            schema = "block long, ids array<long>, held array<double>, row array<int>, col array<int>, w array<double>, halo array<long>, halo_n array<int>, send array<long>, send_n array<int>, send_at array<int>"
            width = len(columns)

            def build(table: pa.Table) -> pa.Table:
                return _built(table.combine_chunks(), width)

            built = points_.unionByName(edges_).unionByName(sends_).groupBy("block").applyInArrow(build, schema)
            self.name = f"blocks_{uuid.uuid4().hex}"
            self.path = f"{shared_dir(self.spark)}/{self.name}"
            with swept(self.spark):
                built.repartition(self.parts, "block").write.format("parquet").option("path", self.path).bucketBy(self.parts, "block").sortBy("block").saveAsTable(self.name)
        self.resident = self.spark.table(self.name)

    def close(self) -> None:
        """Forget the blocks, when no later plan reads them."""
        from ..functions.lineage import discard

        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)

    def start(self, first: Callable[[Block], Outbox]) -> DataFrame:
        """The rows of a first state."""
        columns = self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    block = _block(batch.slice(k, 1), columns)
                    yield from _sent(block, first(block)).to_batches()

        return self.resident.mapInArrow(run, _ROWS)

    def step(self, rows: DataFrame, run: Callable[[Block, Inbox], Outbox], width: int, border: int, given: int = 0) -> DataFrame:
        """The rows after one step; ``width``, ``border`` and ``given`` are the columns of the
        state, of gathered values and of contributions that the rows hold."""
        columns = self.columns

        def one(resident: pa.Table, sent: pa.Table) -> pa.Table:
            block = _block(resident.combine_chunks().to_batches()[0], columns)
            return _sent(block, run(block, _received(block, sent, width, border, given)))

        return rows.groupBy("block").cogroup(self.resident.groupBy("block")).applyInArrow(lambda sent, resident: one(resident, sent), _ROWS)

    def state(self, rows: DataFrame, names: list[str], width: int) -> DataFrame:
        """(id, the first columns of the state; null where they aren't numbers)."""
        columns = self.columns

        def one(sent: pa.Table, resident: pa.Table) -> pa.Table:
            block = _block(resident.combine_chunks().to_batches()[0], columns)
            own = _received(block, sent, width, 0, 0).own
            return pa.Table.from_arrays([pa.array(block.data["id"]), *(pa.array(own[:, k], mask=np.isnan(own[:, k])) for k in range(len(names)))], names=["id", *names])

        own = rows.where(F.col("kind") == OWN)
        return own.groupBy("block").cogroup(self.resident.groupBy("block")).applyInArrow(one, "id long, " + ", ".join(f"{c} double" for c in names))


def _built(table: pa.Table, width: int) -> pa.Table:
    """A block's row from its points (kind 0), edges (1) and what others need of it (2)."""
    kind, other, a, b = (table.column(c).to_numpy() for c in ("kind", "other", "a", "b"))
    name = int(table.column("block")[0].as_py())
    at = np.flatnonzero(kind == 0)
    at = at[np.argsort(a[at])]
    ids = table.column("id").take(pa.array(at)).to_numpy()
    held = table.column("held").take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
    edge = np.flatnonzero(kind == 1)
    w = table.column("w").take(pa.array(edge)).to_numpy()
    outside = other[edge] != name
    needs = np.unique(np.stack([other[edge][outside], b[edge][outside]], axis=1), axis=0) if outside.any() else np.zeros((0, 2), np.int64)
    col = b[edge].astype(np.int64)
    if outside.any():
        both = np.concatenate([needs, np.stack([other[edge][outside], b[edge][outside]], axis=1)])
        _, inverse = np.unique(both, axis=0, return_inverse=True)
        col[outside] = len(ids) + inverse.reshape(-1)[len(needs) :]
    halo, halo_n = np.unique(needs[:, 0], return_counts=True)
    send = np.flatnonzero(kind == 2)
    send = send[np.lexsort((a[send], other[send]))]
    to, to_n = np.unique(other[send], return_counts=True)
    order = np.lexsort((col, a[edge]))
    lists = [(ids, pa.int64()), (held.T.reshape(-1), pa.float64()), (a[edge][order], pa.int32()), (col[order], pa.int32()), (w[order], pa.float64()), (halo, pa.int64()), (halo_n, pa.int32()), (to, pa.int64()), (to_n, pa.int32()), (a[send], pa.int32())]
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in lists]
    return pa.Table.from_arrays([pa.array([name], pa.int64()), *arrays], names=["block", "ids", "held", "row", "col", "w", "halo", "halo_n", "send", "send_n", "send_at"])


def _block(row: pa.RecordBatch, columns: tuple[str, ...]) -> Block:
    name = row.column(0)[0].as_py()
    ids, held, a, col, w, halo, halo_n, to, to_n, at = (row.column(k)[0].values.to_numpy(zero_copy_only=False) for k in range(1, 11))
    data = {"id": ids} | dict(zip(columns, held.reshape(len(columns), len(ids)), strict=True))
    stops = np.cumsum(to_n)
    return Block(name, data, a, col, w, list(zip(halo.tolist(), halo_n.tolist(), strict=True)), [(t, at[e - k : e]) for t, k, e in zip(to.tolist(), to_n.tolist(), stops.tolist(), strict=True)])


def _received(block: Block, sent: pa.Table, width: int, border: int, given: int) -> Inbox:
    sent = sent.combine_chunks()
    origin, kind = sent.column("origin").to_numpy(), sent.column("kind").to_numpy()
    lists = sent.column("v").combine_chunks() if isinstance(sent.column("v"), pa.ChunkedArray) else sent.column("v")
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    rows = {(int(k), int(o)): flat[a:b] for k, o, a, b in zip(kind, origin, offsets, offsets[1:], strict=False)}
    own = rows[OWN, block.name].reshape(-1, width)
    edge = [rows[GATHER, o].reshape(-1, border) for o, _ in block.halo] if border else []
    total = np.zeros((block.n, given))
    for to, slots in block.sends if given else []:
        total[slots] += rows[SCATTER, to].reshape(-1, given)
    return Inbox(own, np.concatenate([*edge, np.zeros((0, border))]), total)


def _sent(block: Block, out: Outbox) -> pa.Table:
    rows = [(block.name, OWN, out.own)]
    if out.gather is not None:
        rows += [(to, GATHER, out.gather[slots]) for to, slots in block.sends]
    if out.scatter is not None:
        at = 0
        for to, k in block.halo:
            rows.append((to, SCATTER, out.scatter[at : at + k]))
            at += k
    flat = [np.ascontiguousarray(v, dtype=float).reshape(-1) for *_, v in rows]
    offsets = np.cumsum([0, *map(len, flat)]).astype(np.int32)
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([block.name] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))], names=["block", "origin", "kind", "v"])


def summed(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` each block's state (an array of one size), summed over all blocks."""
    return _reduced(rows, width, of, np.add, F.sum)


def largest(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The same with the greatest values; empty without blocks."""
    return _reduced(rows, width, of, np.fmax, F.max)


def _reduced(rows: DataFrame, width: int, of: Callable, both: Callable, agg: Callable) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                v = np.asarray(of(batch.column(0)[k].values.to_numpy(zero_copy_only=False).reshape(-1, width)), float).reshape(-1)
                total = v if total is None else both(total, v)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "s"])

    part = rows.where(F.col("kind") == OWN).select("v").mapInArrow(run, "k long, s double")
    found = part.groupBy("k").agg(agg("s").alias("s")).collect()  # as many rows as the array has
    out = np.zeros(len(found))
    for r in found:
        out[r.k] = r.s
    return out
