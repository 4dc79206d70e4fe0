"""Centroid clustering by dual-tree Lloyd rounds.

Each task puts blocks of its vectors into cover trees once; they are stored and serve every
round. A round builds a tree over the centroids and descends both trees together: a pair of
nodes whose distance bounds say that another centroid is nearer for every vector below is
dropped, a node with one centroid left goes to it whole, and leaves are compared exactly with
what remains. Rounds exchange one row per task and centroid; the driver holds the centroids.

All arithmetic that decides or is returned is exact on integers; bounds are floating point
with a margin, so they only ever drop pairs that can't win or tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors of a block (one cover tree), of a leaf at most, and the ratio of a node's radius
#: to the distance within which its children cover its vectors.
BLOCK, LEAF, BASE = 2048, 32, 1.3
#: Bytes of centroids at most: they go to every task.
MOST_BYTES = 256 << 20


@dataclass
class Tree:
    """A cover tree; node n holds the vectors ``order[lo[n]:hi[n]]``, of which those up to
    ``own[n]`` lie in no child. Children follow each other from ``first[n]`` on."""

    order: np.ndarray
    lo: np.ndarray
    own: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    kids: np.ndarray


def _far(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = points - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Every node's vectors lie within its radius of its centre, one of them; the centres of
    its children lie more than radius / BASE apart and cover all its vectors within that.
    Children of a single vector stay in the node itself. Nodes of at most ``leaf`` vectors, or
    of equal ones, aren't parted."""
    order = np.arange(len(points))
    nodes: list[list] = [[0, 0, len(points), 0, 0.0, 0, 0]]  # lo, own, hi, centre, radius, first, kids
    at = 0
    while at < len(nodes):
        lo, _, hi, centre, *_ = nodes[at]
        inside = order[lo:hi].copy()
        far = _far(points[inside], points[centre]) if len(inside) else np.zeros(0)
        radius = float(far.max()) if len(far) else 0.0
        nodes[at][4] = radius
        if hi - lo <= leaf or radius == 0:
            nodes[at][1] = hi
            at += 1
            continue
        single, groups, c = [], [], centre
        while True:
            near = far <= radius / BASE
            if near.sum() == 1:
                single.append(inside[near])
            else:
                groups.append((c, inside[near]))
            inside = inside[~near]
            if not len(inside):
                break
            c = int(inside[0])
            far = _far(points[inside], points[c])
        own = lo + len(single)
        order[lo:own] = np.concatenate(single) if single else []
        nodes[at][1], nodes[at][5], nodes[at][6] = own, len(nodes), len(groups)
        for c, group in groups:
            order[own : own + len(group)] = group
            nodes.append([own, 0, own + len(group), c, 0.0, 0, 0])
            own += len(group)
        at += 1
    lo, own, hi, centre, radius, first, kids = (np.array(c) for c in zip(*nodes, strict=True))
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    return Tree(order, lo, own, hi, place[centre] if len(points) else centre, radius, first, kids)


class Centroids:
    """The centroids of a round under a cover tree, as nodes (centre, radius, children);
    every centroid is a node of radius 0 in the end. ``pairs`` counts exact comparisons."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.exact = rows, rows.astype(float)
        tree = cover_tree(self.exact, 1)
        centre, radius = tree.order[tree.centre].tolist(), tree.radius.tolist()
        self.kids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(centre)
        name = [-1] * len(centre)
        for n in range(len(tree.lo)):
            below = list(range(tree.first[n], tree.first[n] + tree.kids[n]))
            own = tree.order[tree.lo[n] : tree.own[n]].tolist()
            if not below and len(own) == 1:
                name[n] = own[0]
                continue
            for c in own:
                below.append(len(centre))
                centre.append(c)
                radius.append(0.0)
                name.append(c)
                self.kids.append(np.zeros(0, np.int64))
            self.kids[n] = np.array(below)
        self.centre, self.radius, self.name = self.exact[centre], np.array(radius), np.array(name)
        self.size = (rows * rows).sum(axis=1)
        self.pairs = 0

    def narrowed(self, point: np.ndarray, radius: float, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that may hold the nearest centroid of a vector within ``radius`` of
        ``point``, and which of them have children."""
        far = _far(self.centre[nodes], point)
        bound = (far + self.radius[nodes]).min() + radius
        kept = nodes[far - self.radius[nodes] - radius <= bound * (1 + 1e-9) + 1e-6]
        return kept, self.name[kept] < 0

    def under(self, nodes: np.ndarray) -> np.ndarray:
        """The centroids below the nodes, in ascending order."""
        while (inner := self.name[nodes] < 0).any():
            nodes = np.concatenate([nodes[~inner], *(self.kids[n] for n in nodes[inner].tolist())])
        return np.sort(self.name[nodes])

    def nearest(self, vectors: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Of the centroids ``among`` the nearest to each vector, ties to the smaller number."""
        if len(among) == 1:
            return np.full(len(vectors), among[0])
        self.pairs += len(vectors) * len(among)
        # |v|^2 is the same for all; where the sums are exact as doubles, products may be too
        if 4 * vectors.shape[1] * max(np.abs(vectors).max(initial=0), np.abs(self.rows).max(initial=0)) ** 2 < 2**53:
            gap = self.size[among].astype(float) - 2 * (vectors.astype(float) @ self.exact[among].T)
        else:
            gap = self.size[among] - 2 * (vectors @ self.rows[among].T)
        return among[gap.argmin(axis=1)]


def assigned(tree: Tree, vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The nearest centroid of each of the tree's vectors (in its order), ties to the smaller
    number, and the stretches that went to one centroid as whole nodes."""
    out, wholes = np.zeros(len(vectors), np.int64), []
    stack = [(0, np.zeros(1, np.int64))] if len(vectors) else []
    while stack:
        n, nodes = stack.pop()
        lo, own, hi, radius = int(tree.lo[n]), int(tree.own[n]), int(tree.hi[n]), float(tree.radius[n])
        point = vectors[tree.centre[n]].astype(float)
        nodes, inner = centroids.narrowed(point, radius, nodes)
        while inner.any():
            wide = inner & ((centroids.radius[nodes] >= radius) | (tree.kids[n] == 0))
            if not wide.any():
                break
            nodes = np.concatenate([nodes[~wide], *(centroids.kids[k] for k in nodes[wide].tolist())])
            nodes, inner = centroids.narrowed(point, radius, nodes)
        if len(nodes) == 1 and not inner.any():
            out[lo:hi] = centroids.name[nodes[0]]
            wholes.append((lo, hi))
            continue
        if own > lo:
            out[lo:own] = centroids.nearest(vectors[lo:own], centroids.under(nodes))
        stack.extend((k, nodes) for k in range(tree.first[n], tree.first[n] + tree.kids[n]))
    return out, wholes


def _sums(vectors: np.ndarray, to: np.ndarray, wholes: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of each centroid's vectors; whole nodes from running sums."""
    count, total = np.bincount(to, minlength=k), np.zeros((k, vectors.shape[1]), np.int64)
    run = np.zeros((len(vectors) + 1, vectors.shape[1]), np.int64)
    np.cumsum(vectors, axis=0, out=run[1:])
    left = np.ones(len(vectors), bool)
    for lo, hi in wholes:
        total[to[lo]] += run[hi] - run[lo]
        left[lo:hi] = False
    np.add.at(total, to[left], vectors[left])
    return count, total


def integers(vector: Column, scale: float = 256) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _shaped(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def planted(vectors: DataFrame, dims: int, id_type: str = "long") -> DataFrame:
    """The cover trees of blocks of vectors (id, v) as rows, blocks being cut where the
    vectors lie: no shuffle, and equal vectors may lie in any of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in common.in_batches(batches, BLOCK):
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                whole = pa.Table.from_batches(held)
                yield made(whole.slice(0, BLOCK))
                held, size = whole.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield made(pa.Table.from_batches(held))

    def made(block: pa.Table) -> pa.RecordBatch:
        block = block.combine_chunks()
        ids, v = block.column(0).combine_chunks(), _shaped(block.column(1).combine_chunks(), dims)
        if 4 * dims * int(np.abs(v).max(initial=0)) ** 2 >= 2**63:
            raise ArithmeticError("squared distances of these vectors don't fit 64 bits")
        tree = cover_tree(v.astype(float))
        lists = [ids.take(pa.array(tree.order)), pa.array(v[tree.order].reshape(-1)), *(pa.array(getattr(tree, c)) for c in ("lo", "own", "hi", "centre", "radius", "first", "kids"))]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=["ids", "v", "lo", "own", "hi", "centre", "radius", "first", "kids"])

    longs = ", ".join(f"{c} array<long>" for c in ("v", "lo", "own", "hi", "centre"))
    return vectors.mapInArrow(rows, f"ids array<{id_type}>, {longs}, radius array<double>, first array<long>, kids array<long>")


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for k in range(batch.num_rows):
        ids, v, *arrays = (batch.column(c)[k].values for c in range(9))
        lo, own, hi, centre, radius, first, kids = (a.to_numpy(zero_copy_only=False) for a in arrays)
        yield ids, _shaped_flat(v, dims), Tree(np.arange(len(ids)), lo, own, hi, centre, radius, first, kids)


def _shaped_flat(v: pa.Array, dims: int) -> np.ndarray:
    return v.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _round(trees: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, sums): one row per centroid that has vectors."""
    k, dims = centroids.shape
    held = common.share(trees.sparkSession, Centroids(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, now = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), common.opened(held)
        for batch in batches:
            for _, v, tree in _opened(batch, dims):
                c, t = _sums(v, *assigned(tree, v, now), k)
                count, total = count + c, total + t
        some = np.flatnonzero(count)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(total[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), flat], names=["cluster", "n", "sums"])

    part = trees.mapInArrow(run, "cluster long, n long, sums array<long>")
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)]).collect()


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every kept vector, the final centroids).

    Kept are vectors of exactly ``dims`` components that are all there and finite; components
    become floor(scale * x). The first centroids are the k vectors (all, if fewer) with the
    smallest sha256 of ``seed:id``, ties by the vector; a null id hashes as an empty one.
    ``rounds`` times every vector goes to its nearest centroid (squared Euclidean distance,
    ties to the smaller number) and a centroid that has any becomes the floor of their mean;
    then vectors are assigned once more.

    Rows of one id, and repeated rows, are vectors of their own. Empty tables have no rows and
    no centroids. Components beyond 2^27 or so, whose squared distances don't fit 64 bits, are
    an error. Other columns are ignored, whatever they are called."""
    if 8 * k * dims > MOST_BYTES:
        raise ValueError("the centroids must fit every task")
    spark = vectors.sparkSession
    v = vectors[vector_col]
    kept = vectors.where((F.size(v) == dims) & usable(v)).select(vectors[id_col].alias("id"), integers(v, scale).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, dims)
    id_type = kept.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {id_type}, cluster int, distance long"), centroids
    with common.scratch(spark) as steps:
        trees = common.stored(planted(common.spread(kept), dims, id_type), "trees")
        for _ in range(rounds):
            for r in _round(trees, centroids):
                centroids[r.cluster] = [r[f"s{d}"] // r.n for d in range(dims)]
        held = common.share(spark, Centroids(centroids))

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = common.opened(held)
            for batch in batches:
                for ids, rows, tree in _opened(batch, dims):
                    to, _ = assigned(tree, rows, now)
                    gap = rows - now.rows[to]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(to.astype(np.int32)), pa.array((gap * gap).sum(axis=1))], names=[id_col, "cluster", "distance"])

        out = common.stored(trees.mapInArrow(last, f"`{id_col}` {id_type}, cluster int, distance long"), "assigned")
        steps.append(out)
    return out, centroids


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows of :func:`lloyd` with cluster_inertia and inertia (distances summed over the
    row's cluster and over all) and centroid_sha256 (of the final centroid's components as
    decimals joined by commas)."""
    rows, centroids = lloyd(vectors, k, rounds, dims, scale, seed, id_col, vector_col)
    sums = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(c, sums.get(c, 0), sum(sums.values()), name) for c, name in enumerate(names)]
    held = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(held), "cluster").select(F.col("`" + id_col + "`"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
