"""Samples that lie apart: Poisson-disk and farthest-point.

Poisson-disk samples are points of a cloud no two of which are nearer than a distance.

Every point has a priority, a digest of its id. A pass takes the point of highest priority of
each cell of a grid so fine that two points of a cell are always too near, so a candidate has
a bounded number of rivals however dense the cloud is. Of these, a point is kept if no kept
one of higher priority is too near: the same set as taking them one after the other, found in
blocks that exchange their borders (see :mod:`blocked`). Points near a kept one leave; passes
go on until none is left, so the sample is maximal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spatial
from ..functions.lineage import stored
from ..sources import shapes
from . import neighbors, sampling
from .blocked import Block, Graph, Inbox, Outbox, summed

#: Steps of the blocks between two counts of the open points.
PER_COUNT = 3
OPEN, KEPT, GONE = 0.0, 1.0, 2.0


def priority(seed: int = 0) -> Column:
    """A number below 2^52 by id and seed, the lower the sooner: any engine can repeat it."""
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")


def _independent(points: DataFrame, distance: float, size: int | None) -> DataFrame:
    """(id): the points (with their priority) that stay when they are taken by priority, ties
    by the lower id, and those nearer than ``distance`` to one that stayed are left out."""
    pairs = neighbors.radius_join(points, distance).where("src <> dst").select("src", "dst", F.lit(1.0).alias("w"))
    graph = Graph(points, stored(pairs, "rivals"), ("priority",), size)

    def step(block: Block, box: Inbox) -> Outbox:
        first = np.stack([block.data["priority"], block.data["id"].astype(float)], axis=1)
        state, rank = box.own[:, 0], np.concatenate([first, box.border[:, 1:]])
        a, b = block.row, block.col
        sooner = (rank[b, 0] < rank[a, 0]) | ((rank[b, 0] == rank[a, 0]) & (rank[b, 1] < rank[a, 1]))
        a, b = a[sooner], b[sooner]
        while True:
            known = np.concatenate([state, box.border[:, 0]])[b]
            lost, waits = np.zeros(block.n, bool), np.zeros(block.n, bool)
            lost[a[known == KEPT]] = True
            waits[a[known == OPEN]] = True
            new = np.where(state != OPEN, state, np.where(lost, GONE, np.where(waits, OPEN, KEPT)))
            if (new == state).all():
                break
            state = new
        sent = np.concatenate([state[:, None], first], axis=1)
        return Outbox(state[:, None], sent)

    def begin(block: Block) -> Outbox:
        state = np.zeros((block.n, 1))
        return Outbox(state, np.concatenate([state, block.data["priority"][:, None], block.data["id"].astype(float)[:, None]], axis=1))

    try:
        rows = graph.start(begin)
        while True:
            for _ in range(1 if graph.whole else PER_COUNT):
                rows = graph.step(rows, step, 1, 3)
            rows = stored(rows, "thinned")
            left = summed(rows, 1, lambda s: np.array([(s == OPEN).sum()], float))
            if not len(left) or not left[0]:
                return stored(graph.state(rows, ["state"], 1).where(F.col("state") == KEPT).select("id"), "kept")
    finally:
        graph.close()


def spaced(points: DataFrame, distance: float, seed: int = 0, size: int | None = None) -> DataFrame:
    """The rows of a sample in which no two points are nearer than ``distance`` (equal
    distances may be) and to which no point of the cloud could be added.

    Ids are unique, below 2^53 and not null; points with a null coordinate are left out."""
    located = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    left = stored(located.select("id", *[F.col(c).cast("double").alias(c) for c in spatial.XYZ]).withColumn("priority", priority(seed)), "left")
    kept = None
    while not left.isEmpty():
        cells = left.select("*", *spatial.cell(distance / 2)).groupBy("cx", "cy", "cz")
        best = cells.agg(F.min(F.struct("priority", "id", "x", "y", "z")).alias("p")).select("p.*")
        best = stored(best, "candidates")
        chosen = stored(best.join(_independent(best, distance, size), "id", "left_semi"), "chosen")
        kept = chosen if kept is None else kept.unionByName(chosen)
        near = neighbors.radius_join(left, distance, chosen).select(F.col("src").alias("id")).distinct()
        left = stored(left.join(near, "id", "left_anti"), "left")
    return points.limit(0) if kept is None else points.join(kept.select("id"), "id", "left_semi")


#: Candidates for each point asked for, and the distance as a share of the root of the area
#: that each has: a maximal sample then has about 1.3 times the points asked for.
CANDIDATES, SHARE = 6, 0.6


def area(shape: str, **sizes: float) -> float:
    """The surface of a shape of :mod:`shapes`."""
    r, h = sizes.get("radius", 10.0), sizes.get("height", 30.0)
    return {"sphere": 4 * math.pi * r * r, "box": 6 * sizes.get("size", 10.0) ** 2, "cylinder": 2 * math.pi * r * (r + h), "cone": math.pi * r * (r + math.hypot(r, h))}[shape]


def on_shape(spark: SparkSession, shape: str, n: int, seed: int = 0, **sizes: float) -> DataFrame:
    """(id, x, y, z): ``n`` points of a shape's surface, no two nearer than SHARE times the root
    of area / n: the first by priority of a maximal sample of CANDIDATES * n points."""
    if n <= 0:
        return getattr(shapes, shape)(spark, 0, **sizes)
    candidates = stored(getattr(shapes, shape)(spark, CANDIDATES * n, **sizes), "surface")
    found = spaced(candidates, SHARE * math.sqrt(area(shape, **sizes) / n), seed).withColumn("priority", priority(seed))
    return sampling.running(found, [F.asc("priority"), F.asc("id")]).where(F.col("rank_") <= n).select("id", "x", "y", "z")


#: Candidates that each leaf shows the driver, and picks of a round at most.
SHOWN, PICKS = 16, 4096


def farthest(points: DataFrame, n: int, first: int | None = None) -> DataFrame:
    """(rank, id, x, y, z, d2): ``n`` points (all, if there are fewer), each the one farthest
    from those before it (ties: the lower id), from ``first`` (default: the lowest id) on; d2 is
    its squared distance to them (null for the first).

    The cloud lies in the leaves of a balanced partition, and every leaf keeps its points'
    distances to the sample. Of each leaf the driver sees the SHOWN farthest points (at most
    MOST_LEAVES times that); what the others can reach is bounded by the last of them. The
    driver picks among those it sees, lowering their distances pick by pick, as long as the
    best is above all bounds, so a round makes many picks and each is the one that picking one
    by one would make. Then the leaves that a pick may have come nearer are brought up to date,
    where they lie. Points at one place come after all others, by id.

    Ids are unique and not null; points with a null coordinate are left out."""
    from . import partition

    spark, cols = points.sparkSession, "rank long, id long, x double, y double, z double, d2 double"
    located = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in spatial.XYZ])
    start = located if first is None else located.where(F.col("id") == first)
    start = start.orderBy("id").limit(1).collect()
    if not start or n <= 0:
        return spark.createDataFrame([], cols)
    begin = tuple(start[0])
    own = F.when(F.col("id") == begin[0], F.lit(-(2**63))).otherwise(F.col("id"))  # it stands for its place
    places = stored(located.groupBy(*spatial.XYZ).agg(F.min_by("id", own).alias("id")).select("id", *spatial.XYZ), "places")
    total = places.count()
    step = max(1, -(-total // partition.SAMPLE))
    held = places.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select(*spatial.XYZ).limit(2 * partition.SAMPLE).collect()  # bounded
    tree = partition.grown(np.array(held, float).reshape(-1, 3), min(partition.MOST_LEAVES, max(1, -(-total // partition.LEAF))))

    def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = [p[..., c] - q[..., c] for c in range(3)]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

    def shown(leaf: int, ids: np.ndarray, xyz: np.ndarray, d2: np.ndarray) -> pa.Table:
        top = np.lexsort((ids, -d2))[:SHOWN]
        lists = [(ids, pa.int64()), (xyz.reshape(-1), pa.float64()), (d2, pa.float64()), (ids[top], pa.int64()), (xyz[top].reshape(-1), pa.float64()), (d2[top], pa.float64())]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in lists]
        return pa.Table.from_arrays([pa.array([leaf], pa.int64()), *arrays], names=["leaf", "ids", "xyz", "d2", "top", "top_xyz", "top_d2"])

    schema = "leaf long, ids array<long>, xyz array<double>, d2 array<double>, top array<long>, top_xyz array<double>, top_d2 array<double>"

    def gathered(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        xyz = np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)
        return shown(table.column("leaf")[0].as_py(), table.column("id").to_numpy(), xyz, gap(xyz, np.array(begin[1:])))

    state = stored(partition._placed(places, tree).groupBy("leaf").applyInArrow(gathered, schema), "leaves")
    picks: list[tuple] = [(0, *begin, None)]
    wanted = min(n, total)
    while len(picks) < wanted:
        seen = state.select("top", "top_xyz", "top_d2", F.size("ids").alias("n")).collect()  # SHOWN rows a leaf
        ids = np.concatenate([np.array(r.top, np.int64) for r in seen])
        xyz = np.concatenate([np.array(r.top_xyz).reshape(-1, 3) for r in seen])
        d2 = np.concatenate([np.array(r.top_d2) for r in seen])
        bound = max((r.top_d2[-1] for r in seen if r.n > len(r.top)), default=-1.0)
        new: list[tuple] = []
        while len(picks) + len(new) < wanted and len(new) < PICKS:
            best = d2.max()
            # points that aren't seen have higher ids than those as far that are, until a pick
            # has lowered these
            if new and best <= bound:
                break
            at = np.flatnonzero(d2 == best)
            at = at[ids[at].argmin()]
            new.append((len(picks) + len(new), int(ids[at]), *xyz[at].tolist(), float(best)))
            d2 = np.minimum(d2, gap(xyz, xyz[at]))
        picks += new
        if len(picks) == wanted:
            break
        near = np.array([p[2:5] for p in new])

        def update(batches: Iterator[pa.RecordBatch], near: np.ndarray = near) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    leaf, i, p, d = batch.column(0)[k].as_py(), *(batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                    p, d = p.reshape(-1, 3), d.copy()
                    off = np.maximum(np.maximum(p.min(axis=0) - near, near - p.max(axis=0)), 0)
                    for q in near[(off * off).sum(axis=1) <= d.max()]:
                        d = np.minimum(d, gap(p, q))
                    yield from shown(leaf, i, p, d).to_batches()

        state = stored(state.mapInArrow(update, schema), "leaves")
    out = spark.createDataFrame(picks, cols)
    if n <= total:
        return out
    rest = located.join(places.select("id"), "id", "left_anti")
    more = sampling.running(rest, [F.asc("id")]).where(F.col("rank_") <= n - total)
    return out.unionByName(more.select((F.col("rank_") + total - 1).alias("rank"), "id", *spatial.XYZ, F.lit(0.0).alias("d2")))
