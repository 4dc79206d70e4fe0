"""Hard negatives by a pivot table.

A vector x of norm at most M becomes (x, sqrt(M^2 - |x|^2)), an anchor q becomes (q, 0); then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so a high inner product is a short distance. The distances
of all vectors to a few pivots are stored once. For an anchor, the triangle inequality over
them brackets the distance to a vector, and so its score: by pivot once for the box of a run
of vectors that lie together, then for each vector. What the brackets leave is scored exactly,
in integers.

Anchors stay in a task in blocks of bounded size while parts of the vectors stream past, each
part sorted by its nearest pivot. Every task returns its own best few per anchor, so neither
a label that holds a third of the rows nor a single anchor meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .dualtree import integers, usable

#: Pivots, the vectors that they are chosen from, and those of a box.
PIVOTS, SAMPLE, BOX = 8, 512, 128
#: Anchors of a resident block and vectors of a part that streams past.
RESIDENT, STREAM = 4096, 262_144
#: Least and greatest hundredths of a positive's score that make a negative hard.
LOW, HIGH = 50, 95


def pivots(sample: np.ndarray, norm2: int, most: int) -> np.ndarray:
    """Farthest-first vectors of a sample, augmented: each is the one farthest from those
    before, so they bracket from different sides."""
    if not len(sample):
        return np.zeros((0, sample.shape[1] + 1))
    held = augmented(sample, norm2)
    out = [held[0]]
    gap = _far(held, held[0])
    while len(out) < min(most, len(held)) and gap.max() > 0:
        out.append(held[int(gap.argmax())])
        gap = np.minimum(gap, _far(held, out[-1]))
    return np.array(out)


def augmented(v: np.ndarray, norm2: int) -> np.ndarray:
    size = (v * v).sum(axis=1)
    return np.concatenate([v.astype(float), np.sqrt(np.maximum(norm2 - size, 0).astype(float))[:, None]], axis=1)


def _far(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = rows - point
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def to_pivots(rows: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Distances of augmented rows to the pivots."""
    return np.stack([_far(rows, p) for p in held], axis=1) if len(held) else np.zeros((len(rows), 0))


class Anchors:
    """A block of anchors and what brackets scores against it. ``checked`` and ``met`` count
    pairs that were scored exactly and all pairs."""

    def __init__(self, v: np.ndarray, held: np.ndarray, norm2: int):
        self.v, self.norm2, self.size = v, float(norm2), (v * v).sum(axis=1).astype(float)
        flat = np.concatenate([v.astype(float), np.zeros((len(v), 1))], axis=1)
        self.far = to_pivots(flat, held)
        self.checked = self.met = 0

    def survivors(self, far: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """(anchors, rows, mask) by boxes of rows with these pivot distances: pairs whose
        score may lie from ``least`` to ``most`` (both per anchor)."""
        span = self.size + self.norm2
        margin = 1e-9 * (span + 1)
        reach = np.sqrt(np.maximum(span - 2 * least + margin, 0))  # no farther than this
        near = np.sqrt(np.maximum(span - 2 * most - margin, 0))  # no nearer than this
        none = span - 2 * least + margin < 0
        for at in range(0, len(far), BOX):
            rows = slice(at, min(len(far), at + BOX))
            own = far[rows]
            low, high = own.min(axis=0), own.max(axis=0)
            slack = 1e-9 * (1 + high.max(initial=0))
            open_ = ~none
            if far.shape[1]:
                beyond = np.maximum(low - self.far, self.far - high).max(axis=1)
                within = (self.far + high).min(axis=1)
                open_ = ~none & (beyond <= reach + slack) & (within >= near - slack)
            who = np.flatnonzero(open_)
            self.met += len(self.v) * (rows.stop - rows.start)
            if not len(who):
                continue
            mask = np.ones((len(who), len(own)), bool)
            for p in range(far.shape[1]):
                mine = self.far[who, p][:, None]
                mask &= np.abs(mine - own[:, p]) <= (reach[who] + slack)[:, None]
                mask &= mine + own[:, p] >= (near[who] - slack)[:, None]
            some = mask.any(axis=1)
            if some.any():
                self.checked += int(mask.sum())
                yield who[some], rows, mask[some]

    def scores(self, who: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products; as doubles where all sums are exact."""
        top = int(np.abs(rows).max(initial=0)) * int(np.abs(self.v).max(initial=0)) * rows.shape[1]
        if top < 2**53:
            return (self.v[who].astype(float) @ rows.T.astype(float)).astype(np.int64)
        return self.v[who] @ rows.T


class Best:
    """The few best (score, name, row) of each of a number of slots: higher scores first, ties
    to the smaller name, names that are missing last."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.slot, self.score, self.name, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.known = np.zeros(0, bool)
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, name: np.ndarray, known: np.ndarray, row: np.ndarray) -> None:
        both = [np.concatenate(c) for c in ((self.slot, slot), (self.score, score), (self.name, name), (self.known, known), (self.row, row))]
        order = np.lexsort((both[4], both[2], ~both[3], -both[1], both[0]))
        both = [c[order] for c in both]
        first = np.flatnonzero(np.diff(both[0], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.slot, self.score, self.name, self.known, self.row = (c[rank < self.keep] for c in both)
        full = both[0][rank == self.keep - 1]
        self.floor[full] = both[1][rank == self.keep - 1]


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and whether they are known."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def _streams(batches: Iterator[pa.RecordBatch], keys: int, begin: Callable, step: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Groups of sorted rows, ``keys`` columns naming the group and the next its side: all rows
    of side 0 go to ``begin``, those of side 1 to ``step`` as they come."""
    key, block, state = None, [], None
    for batch in common.in_batches(batches, 1024):
        names = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(keys + 1)], axis=1)
        cuts = [0, *(np.flatnonzero((np.diff(names, axis=0) != 0).any(axis=1)) + 1).tolist(), len(names)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if key != tuple(names[lo, :keys]):
                if state is not None:
                    yield from end(state)
                key, block, state = tuple(names[lo, :keys]), [], None
            part = batch.slice(lo, hi - lo)
            if names[lo, keys] == 0:
                block.append(part)
                continue
            if state is None:
                if not block:
                    continue  # vectors that no anchor asks for
                state = begin(pa.Table.from_batches(block).combine_chunks())
            step(state, part)
    if state is not None:
        yield from end(state)


def _flat(column, dims: int) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _dealt(row: str, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(n) if isinstance(n, int) else n).cast("long")


def _each(n: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("long") - 1))


def pivot_table(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel: tuple[int, int] = (7, 10), every: int = 50, scale: float = 256) -> tuple[DataFrame, np.ndarray, int, int]:
    """(table of (row, name, label, anchor, v, far, cell), pivots, M^2, components).

    Rows with a null label, a null vector or a null or non-finite component are left out;
    where the id is divisible by relabel[0], the label becomes (label + 1) % relabel[1].
    Vectors are cut or filled with zeros to the anchors' most components, which changes no
    score. Pivots come from the SAMPLE rows with the least hashes."""
    spark = vectors.sparkSession
    name, label, v = vectors[id_col].cast("long"), vectors[label_col].cast("long"), vectors[vector_col]
    kept = vectors.where(label.isNotNull() & usable(v))
    moved = F.when(F.coalesce(name % relabel[0] == 0, F.lit(False)), (label + 1) % relabel[1]).otherwise(label)
    anchor = F.coalesce(name % every == 0, F.lit(False))
    rows = common.stored(common.spread(kept.select(F.monotonically_increasing_id().alias("row"), name.alias("name"), moved.alias("label"), anchor.alias("anchor"), integers(v, scale).alias("v"))), "vectors")
    dims = max(1, rows.where("anchor").agg(F.max(F.size("v"))).first()[0] or 1)
    shaped = rows.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.get("v", k), F.lit(0).cast("long"))))
    top = shaped.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x))))).first()[0] or 0
    if dims * top * top >= 2**56:
        raise ArithmeticError("scores of these vectors don't fit 64 bits")
    norm2 = shaped.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: m + x * x))).first()[0] or 0
    sample = np.array([r.v for r in shaped.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()], np.int64).reshape(-1, dims)
    held = pivots(sample, norm2, PIVOTS)
    shared = common.share(spark, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, 4096):
            far = to_pivots(augmented(_flat(batch.column(4), dims), norm2), common.opened(shared))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.reshape(-1)))
            cell = far.argmin(axis=1) if far.shape[1] else np.zeros(len(far), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(cell)], names=["row", "name", "label", "anchor", "v", "far", "cell"])

    table = shaped.mapInArrow(run, "row long, name long, label long, anchor boolean, v array<long>, far array<double>, cell long")
    return common.stored(table, "pivots"), held, norm2, dims


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel: tuple[int, int] = (7, 10), every: int = 50, scale: float = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; their positives the first other
    rows of the same label by integer inner product (ties: the smaller id), their hard
    negatives the first rows of another label with low * positive <= 100 * negative <= high *
    positive score. Cleaning as for :func:`pivot_table`.

    A null id is no anchor and comes last among ties; rows of one id, and repeated rows, are
    rows of their own (each is the other's positive). Vectors of different sizes are compared
    as if filled with zeros. Empty tables, and anchors without positives or negatives, have no
    rows. Components so large that scores may pass 2^56 are an error. Other columns are
    ignored, whatever they are called."""
    spark = vectors.sparkSession
    with common.scratch(spark) as steps:
        table, held, norm2, dims = pivot_table(vectors, id_col, vector_col, label_col, relabel, every, scale)
        shared = common.share(spark, held)

        # labels with more than one block of anchors or part of vectors: at most a row per part
        counts = table.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / STREAM).alias("parts"), F.greatest(F.ceil(F.sum(F.col("anchor").cast("long")) / RESIDENT), F.lit(1)).alias("blocks"))
        hot = F.broadcast(common.stored(counts.where("parts > 1 OR blocks > 1"), "hot", 1))
        of = table.join(hot, "label", "left").fillna(1, ["parts", "blocks"])
        side = lambda df, n, block, part: df.select("label", block.alias("p"), part.alias("q"), F.lit(n).cast("long").alias("side"), "row", "name", "v", "far", "cell")
        one = side(of.where("anchor"), 0, _dealt("row", F.col("blocks")), _each(F.col("parts")))
        two = side(of.withColumn("p", _each(F.col("blocks"))), 1, F.col("p"), _dealt("row", F.col("parts")))
        met = one.unionByName(two).repartition("label", "p", "q").sortWithinPartitions("label", "p", "q", "side", "cell", F.col("far")[0])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def begin(block: pa.Table) -> tuple:
                return block.column("row").to_numpy(), Anchors(_flat(block.column("v"), dims), common.opened(shared), norm2), Best(block.num_rows, positives)

            def step(state: tuple, part: pa.RecordBatch) -> None:
                own, anchors, best = state
                v, far, row, (name, known) = _flat(part.column("v"), dims), _flat(part.column("far"), len(common.opened(shared))), part.column("row").to_numpy(), _ints(part.column("name"))
                floor = np.maximum(best.floor, -(2**60)).astype(float)
                for who, at, mask in anchors.survivors(far, floor, np.full(len(floor), 2.0**60)):
                    score = anchors.scores(who, v[at])
                    i, j = np.nonzero(mask & (score >= best.floor[who][:, None]) & (own[who][:, None] != row[at]))
                    if len(i):
                        best.add(who[i], score[i, j], name[at][j], known[at][j], row[at][j])

            def end(state: tuple) -> Iterator[pa.RecordBatch]:
                own, _, best = state
                yield pa.RecordBatch.from_arrays([pa.array(own[best.slot]), pa.array(best.score), pa.array(best.name, mask=~best.known), pa.array(best.row)], names=["anchor", "score", "name", "row"])

            yield from _streams(batches, 3, begin, step, end)

        found = met.mapInArrow(near, "anchor long, score long, name long, row long")
        first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("name").asc_nulls_last(), "row")
        pairs = found.withColumn("slot", F.row_number().over(first)).where(F.col("slot") <= positives)
        pairs = common.stored(pairs.select("anchor", (F.col("slot") - 1).cast("long").alias("slot"), "score", "name"), "positives")

        # every anchor with the scores of its positives, against the rows of all other labels
        wanted = pairs.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda s: s["score"]).alias("asked"))
        asking = common.stored(table.where("anchor").join(wanted, "row"), "anchors")
        n, m = table.count(), asking.count()
        blocks = max(1, -(-m // RESIDENT))
        parts = max(1, -(-n // STREAM), -(-4 * spark.sparkContext.defaultParallelism // blocks))
        side = lambda df, n, block, part, asked: df.select(block.alias("p"), part.alias("q"), F.lit(n).cast("long").alias("side"), "row", "name", "label", "v", "far", "cell", asked.alias("asked"))
        one = side(asking, 0, _dealt("row", blocks), _each(parts), F.col("asked"))
        two = side(table.withColumn("p", _each(blocks)), 1, F.col("p"), _dealt("row", parts), F.lit(None).cast("array<long>"))
        met = one.unionByName(two).repartition("p", "q").sortWithinPartitions("p", "q", "side", "cell", F.col("far")[0])

        def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def begin(block: pa.Table) -> tuple:
                asked = block.column("asked").combine_chunks()
                count = np.diff(asked.offsets.to_numpy())
                mark = np.zeros((block.num_rows, positives), np.int64)
                has = np.arange(positives) < count[:, None]
                mark[has] = asked.flatten().to_numpy()
                return block.column("row").to_numpy(), block.column("label").to_numpy(), mark, has, Anchors(_flat(block.column("v"), dims), common.opened(shared), norm2), Best(block.num_rows * positives, negatives)

            def step(state: tuple, part: pa.RecordBatch) -> None:
                _, labels, mark, has, anchors, best = state
                v, far, row, label, (name, known) = _flat(part.column("v"), dims), _flat(part.column("far"), len(common.opened(shared))), part.column("row").to_numpy(), part.column("label").to_numpy(), _ints(part.column("name"))
                floor = np.maximum(best.floor, -(2**60)).reshape(mark.shape)
                # floating-point ends of the windows, a little wider; an empty window asks for nothing
                ends = np.where(has, np.maximum(low * mark / 100, floor), np.inf), np.where(has, high * mark / 100, -np.inf)
                ends = np.where(ends[0] <= ends[1] + 1e-6 * (1 + np.abs(ends[1])), ends[0], np.inf), ends[1]
                least, most = ends[0].min(axis=1), ends[1].max(axis=1)
                least = np.where(np.isfinite(least), least, 2.0**60)
                most = np.where(np.isfinite(most), most, -(2.0**60))
                for who, at, mask in anchors.survivors(far, least, most):
                    score = anchors.scores(who, v[at])
                    mask = mask & (labels[who][:, None] != label[at])
                    for s in range(positives):
                        top = mark[who, s][:, None]
                        i, j = np.nonzero(mask & has[who, s][:, None] & (100 * score >= low * top) & (100 * score <= high * top) & (score >= floor[who, s][:, None]))
                        if len(i):
                            best.add(who[i] * positives + s, score[i, j], name[at][j], known[at][j], row[at][j])
                    floor = np.maximum(best.floor, -(2**60)).reshape(mark.shape)

            def end(state: tuple) -> Iterator[pa.RecordBatch]:
                own, *_, best = state
                yield pa.RecordBatch.from_arrays([pa.array(own[best.slot // positives]), pa.array(best.slot % positives), pa.array(best.score), pa.array(best.name, mask=~best.known), pa.array(best.row)], names=["anchor", "slot", "score", "name", "row"])

            yield from _streams(batches, 2, begin, step, end)

        found = met.mapInArrow(hard, "anchor long, slot long, score long, name long, row long")
        first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("name").asc_nulls_last(), "row")
        found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
        found = found.select("anchor", "slot", "rank", F.col("name").alias("negative_id"), F.col("score").alias("negative_score"))
        ids = table.where("anchor").select(F.col("row").alias("anchor"), F.col("name").alias("anchor_id"))
        named = pairs.select("anchor", "slot", F.col("name").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
        out = named.join(found, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = common.stored(out, "negatives")
        steps.append(out)
    return out
