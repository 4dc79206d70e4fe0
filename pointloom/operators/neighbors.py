"""Neighbour search as equi-joins on grid cells, and over a balanced partition.

A radius search explodes each query point over the 27 cells around it and joins on the
cell, which plans as a hash or sort-merge join; adaptive execution splits skewed cells.

The nearest within a radius are searched in cells of several sizes: a query starts at the
largest size at which no cell around it is crowded, and goes on at larger ones while it has too
few neighbours. Where cells are crowded, places are searched instead of points: of the points
at one place only the k with the least ids can be among the nearest, and all queries at one
place have the same answer. The nearest at any distance come from :mod:`partition`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spatial
from ..functions.lineage import stored
from . import partition, regions

#: Points of a cell from which it is crowded (or 8 k, if that is more).
DENSE = 512
#: A level's cells are a STEP-th of the level's before; a crowd that LEVELS of them don't part
#: is searched as it is.
STEP, LEVELS = 4, 20
#: Points of a box that one task holds, points that they meet there, distances measured at once.
HELD, MET, AT_ONCE = 65_536, 131_072, 1 << 16


def _side(points: DataFrame, prefix: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    return points.select(F.col("id").alias(key), *by, *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in spatial.XYZ])


def radius_join(queries: DataFrame, radius: float, targets: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """All (src, dst) with squared distance d2 < radius^2, a point itself included; with
    ``by``, only points that are equal in these columns.

    Points with a null coordinate have no neighbours; empty clouds give no rows."""
    t = _side(queries if targets is None else targets, "t", "dst", by).select("*", *spatial.cell(radius, prefix="t"))
    probes = _probes(_side(queries, "s", "src", by), radius, "s")
    met = probes.join(t, ["cx", "cy", "cz", *by]).withColumn("d2", spatial.sq_dist("s", "t"))
    return met.where(F.col("d2") < F.lit(radius * radius)).select("src", "dst", "d2", "sx", "sy", "sz", "tx", "ty", "tz", *by)


def radius_classes(points: DataFrame, radius: float) -> DataFrame:
    """(id, class_id, links) of every point: how many other points lie within ``radius`` (squared
    distance below radius^2), and the least id of the component that these links make.

    All links of :func:`radius_join` count, none becomes a row. The points of a box of 4^3 cells
    are held in parts, and the points around it come by in slots, so a task has HELD + MET points
    at most; between two cells only those distances are measured that their extents leave open.
    The points of one cell are always linked, so the components are those of linked cells. Cells
    are a power of two wide, so that their numbers are exact.

    Points with a coordinate that is null or not finite have no links; ids are unique."""
    size = 2.0 ** math.floor(math.log2(0.57 * radius))  # the diagonal is shorter than the radius
    reach, axes, box = math.ceil(radius / size), ["cx", "cy", "cz"], ["bx", "by", "bz"]
    number = lambda c: F.when(F.abs(F.col(c) / size) < 2.0**60, F.floor(F.col(c) / size)).otherwise(F.shiftright(F.xxhash64(c), 2))  # noqa: E731  beyond, only equal ones are near
    finite = " AND ".join(f"abs({c}) < double('infinity')" for c in spatial.XYZ)
    own = _located(points).select("id", *[F.col(c).cast("double").alias(c) for c in spatial.XYZ]).where(finite).select("*", *[number(c).alias(f"c{c}") for c in spatial.XYZ])
    cells = own.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("cell"))
    placed = stored(own.join(cells.drop("n"), axes), "placed")
    cells = stored(cells, "cells")
    inside = [F.shiftright(a, 2).alias(b) for a, b in zip(axes, box, strict=True)]

    def around(df: DataFrame, *columns: str) -> DataFrame:
        """Rows once for each box that has cells within reach."""
        out = df
        for a, b in zip(axes, box, strict=True):
            out = out.withColumn(b, F.explode(F.sequence(F.shiftright(F.col(a) - reach, 2), F.shiftright(F.col(a) + reach, 2))))
        return out.select(*columns, *box)

    times = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    boxes = cells.groupBy(*inside).agg(F.sum("n").alias("held")).join(around(cells, "n").groupBy(*box).agg(F.sum("n").alias("met")), box)
    boxes = stored(boxes.select(*box, times("held", HELD).alias("parts"), times("met", MET).alias("slots")), "boxes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    key, what = [*box, "part", "slot"], ["cell", *spatial.XYZ]
    held = placed.select("id", *what, *inside).join(boxes, box).select(*box, "id", *what, spot("parts").alias("part"), every("slots").alias("slot"))
    met = around(placed, "id", *what).join(boxes, box).select(*box, *what, spot("slots").alias("slot"), every("parts").alias("part"))

    def counted(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, n, src, dst = _linked(a, b, radius * radius)
        nulls = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"id": pa.chunked_array([pa.array(ids), nulls(len(src))]), "n": pa.chunked_array([pa.array(n), nulls(len(src))]), "src": pa.chunked_array([nulls(len(ids)), pa.array(src)]), "dst": pa.chunked_array([nulls(len(ids)), pa.array(dst)])})

    met = met.toDF(*met.columns)  # columns of their own, as both sides come from placed
    found = stored(held.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(counted, "id long, n long, src long, dst long"), "linked")
    links = found.where("id IS NOT NULL").groupBy("id").agg((F.sum("n") - 1).alias("links"))
    classes = regions.components(found.where("src IS NOT NULL").select("src", "dst").distinct()).select(F.col("id").alias("cell"), F.col("label").alias("class_id"))
    known = placed.select("id", "cell").join(classes, "cell").join(links, "id").select("id", "class_id", "links")
    return points.select("id").join(known, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _linked(a: pa.Table, b: pa.Table, r2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, links) of the points of ``a`` with those of ``b``, the linked cells of both."""

    def sides(t: pa.Table) -> tuple:
        cell = t["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        xyz = np.stack([t[c].to_numpy()[order] for c in spatial.XYZ])
        name, start = np.unique(cell[order], return_index=True)
        return order, xyz, name, start, np.diff(start, append=len(cell)), np.minimum.reduceat(xyz, start, axis=1), np.maximum.reduceat(xyz, start, axis=1)

    empty = np.zeros(0, np.int64)
    if not a.num_rows or not b.num_rows:
        return empty, empty, empty, empty
    order, p, name_a, start_a, size_a, low_a, high_a = sides(a)
    _, q, name_b, start_b, size_b, low_b, high_b = sides(b)
    links, src, dst = np.zeros(len(order), np.int64), [], []
    with np.errstate(over="ignore"):
        for k in range(len(name_a)):
            gap = np.maximum(np.maximum(low_b - high_a[:, k, None], low_a[:, k, None] - high_b), 0.0)
            span = np.maximum(high_b - low_a[:, k, None], high_a[:, k, None] - low_b)
            near = (gap * gap).sum(axis=0) < r2 * (1 + 1e-9)
            whole = (span * span).sum(axis=0) < r2 * (1 - 1e-9)
            mine = slice(start_a[k], start_a[k] + size_a[k])
            links[mine] += size_b[whole].sum()
            linked = whole.copy()
            open_ = np.flatnonzero(near & ~whole)
            if len(open_):
                ends = np.cumsum(size_b[open_])
                at = np.repeat(start_b[open_] - ends + size_b[open_], size_b[open_]) + np.arange(ends[-1])
                hit = _measured(p[:, mine], q[:, at], r2, links[mine])
                linked[open_] = np.logical_or.reduceat(hit, ends - size_b[open_])
            src.append(np.full(int(linked.sum()), name_a[k]))
            dst.append(name_b[linked])
    return a["id"].to_numpy()[order], links, np.concatenate(src), np.concatenate(dst)


def _measured(p: np.ndarray, q: np.ndarray, r2: float, links: np.ndarray) -> np.ndarray:
    """Adds to ``links`` of each p the points q that are near; returns the q that any p is near."""
    hit = np.zeros(q.shape[1], bool)
    wide = 2048
    tall = AT_ONCE // wide
    for j in range(0, q.shape[1], wide):
        x, y, z = q[:, None, j : j + wide]
        for i in range(0, p.shape[1], tall):
            u, v, w = p[:, i : i + tall, None]
            d2 = u - x
            d2 *= d2
            for s, t in ((v, y), (w, z)):
                d = s - t
                d *= d
                d2 += d
            close = d2 < r2
            links[i : i + tall] += np.count_nonzero(close, axis=1)
            hit[j : j + wide] |= close.any(axis=0)
    return hit


def _probes(points: DataFrame, size: float, prefix: str = "") -> DataFrame:
    """``points`` once for each of the 27 cells around them (cx, cy, cz)."""
    own = points.select("*", *spatial.cell(size, prefix=prefix))
    around = F.array(*[F.struct(*[(F.col(f"c{c}") + o).alias(f"c{c}") for c, o in zip(spatial.XYZ, off, strict=True)]) for off in [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]])
    return own.select(*points.columns, F.explode(around).alias("near_")).select(*points.columns, "near_.*")


def _ranked(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src; ties go to the lower id."""
    order = Window.partitionBy("src").orderBy("d2", "dst")
    return edges.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def _crowded(points: DataFrame, size: float, limit: int, by: tuple[str, ...]) -> DataFrame:
    cells = points.select(*by, *spatial.cell(size)).groupBy("cx", "cy", "cz", *by).agg(F.count(F.lit(1)).alias("n"))
    return cells.where(F.col("n") > limit).drop("n")


def _located(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return points.select("id", *by, *spatial.XYZ).where(" AND ".join(f"{c} IS NOT NULL" for c in spatial.XYZ))


def _by_level(queries: DataFrame, cloud: DataFrame, base: float, limit: int, by: tuple[str, ...]) -> list[DataFrame]:
    """The queries by the level (``base`` over STEP to its power) at which the cells around
    them are no longer crowded. Each level looks at the crowded part of the level before only."""
    out, size = [], base
    while len(out) < LEVELS:
        cells = _crowded(cloud, size, limit, by)
        if cells.isEmpty():
            break
        cells = stored(cells, "cells")
        hit = stored(_probes(queries, size).join(cells, ["cx", "cy", "cz", *by], "left_semi").select("id").distinct(), "hit")
        out.append(queries.join(hit, "id", "left_anti"))
        queries = stored(queries.join(hit, "id", "left_semi"), "queries")
        cloud = stored(cloud.select("*", *spatial.cell(size)).join(cells, ["cx", "cy", "cz", *by], "left_semi").select("id", *by, *spatial.XYZ), "crowd")
        size /= STEP
    return [*out, queries]


def _search(queries: DataFrame, cloud: DataFrame, k: int, base: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The at most k nearest within ``base``."""
    limit = max(DENSE, 8 * k)
    points, groups = queries, [queries]
    crowded = not _crowded(cloud, base, limit, by).isEmpty()
    if crowded:
        order = Window.partitionBy(*by, *spatial.XYZ).orderBy("id")
        cloud = stored(cloud.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= k).drop("n_"), "cloud")
        places = stored(queries.groupBy(*by, *spatial.XYZ).agg(F.min("id").alias("id")).select("id", *by, *spatial.XYZ), "places")
        groups = _by_level(places, cloud, base, limit, by)
    done, left, size = [], None, base / STEP ** (len(groups) - 1)
    while groups:
        active = groups.pop() if left is None else left.unionByName(groups.pop())
        found = _ranked(radius_join(active, size, cloud, by), k)
        if not groups:
            done.append(found)
            break
        left, full = _split(active, found, k)
        done.append(full)
        size *= STEP
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    if not crowded:
        return out
    return out.drop("src").join(_side(points, "s", "src", by), ["sx", "sy", "sz", *by]).select("src", "dst", "d2", "sx", "sy", "sz", "tx", "ty", "tz", *by, "rn")


def _split(active: DataFrame, found: DataFrame, want: int) -> tuple[DataFrame, DataFrame]:
    """(queries that are short of neighbours, edges of the others)."""
    found = stored(found, "near")
    full = found.where(F.col("rn") == want).select(F.col("src").alias("id"))
    return stored(active.join(full, "id", "left_anti"), "left"), found.join(full, F.col("src") == F.col("id"), "left_semi")


def hybrid(queries: DataFrame, radius: float, k: int, targets: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The at most k nearest within ``radius``: edges with rank ``rn``, ties to the lower id.
    With ``by``, only points that are equal in these columns are neighbours.

    Points with a null coordinate have no neighbours; ids are unique."""
    q = _located(queries, by)
    return _search(q, q if targets is None else _located(targets, by), k, radius, by=by)


def knn(queries: DataFrame, k: int, targets: DataFrame | None = None) -> DataFrame:
    """The k nearest of each query (fewer only if the cloud is smaller), self included, ties to
    the lower id. Points with a null coordinate have no neighbours; ids are unique."""
    q = _located(queries).select(F.col("id").cast("long"), *[F.col(c).cast("double").alias(c) for c in spatial.XYZ])
    if targets is None:
        return partition.nearest(q, q, k, True)
    t = _located(targets).select(F.col("id").cast("long"), *[F.col(c).cast("double").alias(c) for c in spatial.XYZ])
    return partition.nearest(q, t, k, False)


def nearest_other(points: DataFrame) -> DataFrame:
    """(id, d): distance of each point to its nearest other point; a lone point has none."""
    return knn(points, 2).where(F.col("src") != F.col("dst")).groupBy(F.col("src").alias("id")).agg(F.sqrt(F.min("d2")).alias("d"))


def cloud_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, d): distance of each point of ``a`` to the nearest point of ``b``."""
    return knn(a, 1, b).select(F.col("src").alias("id"), F.sqrt("d2").alias("d"))


def rms_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``rms``: root mean square of the nearest-point distances from a to b."""
    d = cloud_distance(a, b)
    return d.agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"))


#: Rows of a resident block and of a stream that passes it, in feature matching.
RESIDENT, STREAM = 16_384, 262_144


def feature_match(a: DataFrame, b: DataFrame, feature: str = "feature", subsample: int = -1, seed: int = 0) -> DataFrame:
    """(id0, id1, dist): the row of ``b`` nearest in feature space to each row of ``a``, ties
    to the lower id.

    ``a`` is cut into blocks that stay in a task while the rows of a part of ``b`` stream
    past in batches of dense products; the parts' bests are reduced by key. A block is
    copied once for each STREAM rows of ``b``, a row of ``b`` once for each RESIDENT rows of
    ``a``, and a task holds one block. Products only choose candidates: all within their
    rounding error are measured exactly. With 0 < subsample < rows of ``a``, both sides are
    sampled without replacement first. Null features have no match and are none's."""
    if 0 < subsample < a.count():
        a, b = (s.orderBy(F.rand(seed)).limit(subsample) for s in (a, b))

    def side(rows: DataFrame) -> tuple[DataFrame, int]:
        held = rows.where(F.col(feature).isNotNull()).select("id", F.col(feature).cast("array<double>").alias("f"))
        return held, held.count()

    (left, n), (right, m) = side(a), side(b)
    blocks, parts = max(1, -(-n // RESIDENT)), max(1, -(-m // STREAM))
    spot = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = left.select(spot(blocks).alias("p"), every(parts).alias("q"), F.lit(0).alias("side"), "id", "f")
    two = right.select(every(blocks).alias("p"), spot(parts).alias("q"), F.lit(1).alias("side"), "id", "f")

    def run(batches):
        key, block, ids, f = None, [], None, None
        best_d = best_i = None

        def made():
            known = best_i >= 0
            return pa.RecordBatch.from_arrays([pa.array(ids[known]), pa.array(best_i[known]), pa.array(best_d[known])], names=["id0", "id1", "dist"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                some = batch.slice(lo, hi - lo)
                if key != tuple(keys[lo, :2]):
                    if best_i is not None:
                        yield made()
                    key, block, best_i = tuple(keys[lo, :2]), [], None
                names = some.column(3).to_numpy()
                rows = np.array(some.column(4).to_pylist(), dtype=float)
                if keys[lo, 2] == 0:
                    block.append((names, rows))
                    continue
                if best_i is None:
                    if not block:
                        continue
                    ids, f = np.concatenate([x[0] for x in block]), np.concatenate([x[1] for x in block])
                    best_d, best_i = np.full(len(ids), np.inf), np.full(len(ids), -1, dtype=np.int64)
                for at in range(0, len(names), 1024):
                    _improve(f, best_d, best_i, names[at : at + 1024], rows[at : at + 1024])
        if best_i is not None:
            yield made()

    dealt = one.unionByName(two).repartition("p", "q").sortWithinPartitions("p", "q", "side")
    found = dealt.mapInArrow(run, "id0 long, id1 long, dist double")
    return found.groupBy("id0").agg(F.min(F.struct("dist", "id1")).alias("m")).select("id0", F.col("m.id1").alias("id1"), F.col("m.dist").alias("dist"))


def _improve(f: np.ndarray, best_d: np.ndarray, best_i: np.ndarray, names: np.ndarray, rows: np.ndarray) -> None:
    """Lower the best distances of the rows ``f`` by those to ``rows``."""
    own = (rows * rows).sum(axis=1)
    slack = 8 * (f.shape[1] + 4) * np.finfo(float).eps
    for at in range(0, len(f), 1024):
        p = f[at : at + 1024]
        size = (p * p).sum(axis=1)
        d2 = size[:, None] + own[None, :] - 2 * p @ rows.T
        near = d2 <= (d2.min(axis=1) + slack * (size + own.max()))[:, None]
        i, j = np.nonzero(near)
        for lo in range(0, len(i), 1 << 18):
            u, v = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
            dist = np.sqrt(((p[u] - rows[v]) ** 2).sum(axis=1))
            order = np.lexsort((names[v], dist, u))
            first = order[np.flatnonzero(np.diff(u[order], prepend=-1))]
            u, dist, name = u[first] + at, dist[first], names[v[first]]
            better = (dist < best_d[u]) | ((dist == best_d[u]) & (name < best_i[u]))
            best_d[u[better]], best_i[u[better]] = dist[better], name[better]
