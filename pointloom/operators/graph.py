"""Graphs over clouds and their filters.

Edges come from the neighbour search and hold both ends' coordinates, so degrees, filters
and scores are one grouped aggregate over ``src`` on the partitioning that the ranking
already has. The graph is directed: each point keeps its own k nearest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import discard, scratch, stored
from . import geometry, neighbors
from .blocked import Block, Graph, Inbox, Outbox, largest, summed


def edges(points: DataFrame, radius: float, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    return neighbors.hybrid(points, radius, k, by=by)


def adjacency(points: DataFrame, radius: float, k: int, weight: str = "const", by: tuple[str, ...] = ()) -> DataFrame:
    """Edges with weight ``w``; with ``by``, within points equal in these columns (batches).

    const: exp(-1) for every edge, self edge included. gauss: exp(-d2). curv: d2 is scaled
    by exp(-c^2) exp(-k_i^2/30) with the curvature c and neighbour count k_i of the source.
    blend: d2 times 0.2 exp(-c^2/0.005) + 0.8 k_i/k. In the last three, edges of length 0
    are absent."""
    e = edges(points, radius, k, by)
    if weight == "const":
        return e.withColumn("w", F.lit(math.exp(-1)))
    if weight == "gauss":
        return e.where("d2 > 0").withColumn("w", F.exp(-F.col("d2")))
    if weight not in ("curv", "blend"):
        raise ValueError(f"unknown weight {weight!r}")
    e = e.withColumn("ki", F.count(F.lit(1)).over(Window.partitionBy("src")))
    c = geometry.curvature(e).select(F.col("id").alias("src"), F.col("curvature").alias("c"))
    e = e.join(c, "src").where("d2 > 0")
    if weight == "curv":
        a = F.col("d2") * F.exp(-F.col("c") * F.col("c")) * F.exp(-F.col("ki") * F.col("ki") / 30)
    else:
        a = F.col("d2") * (0.2 * F.exp(-F.col("c") * F.col("c") / 0.005) + 0.8 * F.col("ki") / k)
    return e.withColumn("w", F.exp(-a)).drop("c", "ki")


def degree(adj: DataFrame) -> DataFrame:
    """(id, degree): row sums of the weights."""
    return adj.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))


def _sums(adj: DataFrame) -> DataFrame:
    return adj.groupBy("src", "sx", "sy", "sz").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("d"), *[F.sum(F.col("w") * F.col(f"t{c}")).alias(f"w{c}") for c in "xyz"])


def filtered(points: DataFrame, adj: DataFrame, kind: str = "high") -> DataFrame:
    """(id, k, x, y, z, fx, fy, fz): the coordinates under a graph filter.

    high: D - W. rw: I - W/D. low: W/D. all: identity. Points without edges keep k = 0 and
    a zero high-pass, and their own coordinates in the low-pass."""
    if kind not in ("high", "rw", "low", "all"):
        raise ValueError(f"unknown filter {kind!r}")
    s = _sums(adj).select(F.col("src").alias("id"), "k", "d", "wx", "wy", "wz")
    p = points.select("id", "x", "y", "z").join(s, "id", "left")

    def out(c: str):
        own, mean = F.col(c), F.try_divide(F.col(f"w{c}"), F.col("d"))
        return {
            "high": F.coalesce(F.col("d") * own - F.col(f"w{c}"), F.lit(0.0)),
            "rw": F.coalesce(own - mean, F.lit(0.0)),
            "low": F.coalesce(mean, own),
            "all": own,
        }[kind].alias(f"f{c}")

    return p.select("id", F.coalesce("k", F.lit(0)).alias("k"), "x", "y", "z", *[out(c) for c in "xyz"])


def score(flt: DataFrame, form: str = "squared") -> DataFrame:
    """(id, k, score) of filtered coordinates: squared norm, norm, or squared norm times the
    squared neighbour count (``density``)."""
    sq = F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz")
    forms = {"squared": sq, "norm": F.sqrt(sq), "density": sq * F.col("k") * F.col("k")}
    if form not in forms:
        raise ValueError(f"unknown score {form!r}")
    return flt.select("id", "k", forms[form].alias("score"))


def high_pass_score(points: DataFrame, radius: float, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, k, score) of the constant-weight graph in one aggregate: with the mean m of the
    k neighbours, score = exp(-2) k^2 |x - m|^2. Every point is its own neighbour."""
    e = edges(points, radius, k, by)
    m = e.groupBy("src", "sx", "sy", "sz").agg(F.count(F.lit(1)).alias("k"), *[F.avg(f"t{c}").alias(f"m{c}") for c in "xyz"])
    sq = sum(((F.col(f"s{c}") - F.col(f"m{c}")) * (F.col(f"s{c}") - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0))
    return m.select(F.col("src").alias("id"), "k", (F.lit(math.exp(-2)) * F.col("k") * F.col("k") * sq).alias("score"))


#: Products between two looks at the norm.
PRODUCTS = 4


def largest_eigenvalue(points: DataFrame, adj: DataFrame, tolerance: float = 1e-9, steps: int = 10_000, size: int | None = None) -> float:
    """Magnitude of the adjacency's largest eigenvalue by power iteration from the vector of
    ones: products exchange border values of blocks of the cloud (see :mod:`blocked`), a job
    holds PRODUCTS of them, and the driver gets one norm. A graph whose blocks are alone is
    iterated within them. Ends when the estimate changes by less than ``tolerance`` of itself;
    it is an error to reach ``steps``. 0 without edges."""
    graph = Graph(points.select("id", *"xyz"), adj.select("src", "dst", "w"), (), size)

    def alone(block: Block) -> Outbox:
        v, last = np.full((block.n, 1), 1 / math.sqrt(max(1, block.n))), -1.0
        for _ in range(-(-steps // PRODUCTS)):
            for _ in range(PRODUCTS):
                v = block.times(v, np.zeros((0, 1)))
            norm = float(np.sqrt((v * v).sum()))
            value = norm ** (1 / PRODUCTS)
            if not norm or abs(value - last) <= tolerance * value:
                return Outbox(np.full((block.n, 1), value))
            v, last = v / norm, value
        raise RuntimeError("the power iteration doesn't converge")

    try:
        if graph.whole:
            found = largest(graph.start(alone), 1, lambda s: s.max(axis=0, initial=0.0))
            return float(found[0]) if len(found) else 0.0
        n, last, norm = graph.count, -1.0, 1.0
        rows = graph.start(lambda b: Outbox(v := np.full((b.n, 1), 1 / math.sqrt(n)), v))
        for _ in range(-(-steps // PRODUCTS)):
            for k in range(PRODUCTS):

                def product(block: Block, box: Inbox, scale: float = norm if k == 0 else 1.0) -> Outbox:
                    v = block.times(box.own, box.border) / scale
                    return Outbox(v, v)

                rows = graph.step(rows, product, 1, 1)
            rows = stored(rows, "vector")
            norm = math.sqrt(summed(rows, 1, lambda s: (s * s).sum(axis=0))[0])
            value = norm ** (1 / PRODUCTS)
            if not norm or abs(value - last) <= tolerance * value:
                return value
            last = value
        raise RuntimeError("the power iteration doesn't converge")
    finally:
        graph.close()


def haar_low_pass(points: DataFrame, adj: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """X + A X / lambda, with the adjacency's eigenvalue of largest magnitude."""
    norm = largest_eigenvalue(points, adj, tolerance)
    s = _sums(adj).select(F.col("src").alias("id"), "wx", "wy", "wz")
    p = points.select("id", "x", "y", "z").join(s, "id", "left")
    scale = F.lit(1 / norm if norm else 0.0)
    return p.select("id", *[(F.col(c) + scale * F.coalesce(F.col(f"w{c}"), F.lit(0.0))).alias(c) for c in "xyz"])


#: The degree of a filter at most, what a filter may spread the columns apart at most, and
#: columns beside those asked for.
DEGREE, SPREAD, SPARE = 48, 1e6, 12
#: Rows that refer to a point at most, for its row of the symmetric matrix to lie in its block.
HUB = 256
#: Numbers that the exchanges of one job move at about most (256 MB); then the state is stored.
MOVED = 1 << 25


def fourier(points: DataFrame, adj: DataFrame, count: int = 100, tolerance: float = 1e-7, rounds: int = 200, size: int | None = None) -> DataFrame:
    """(n, eigenvalue, x, y, z, residual): graph Fourier coefficients of the coordinates for
    the ``count`` eigenvalues of largest magnitude of the Laplacian D - W, made symmetric by
    the mean with its transpose (all, if there are fewer points).

    Subspace iteration: ``count`` + SPARE columns, filtered by Chebyshev polynomials that damp
    what lies below the smallest of them, and turned to the best eigenvectors in between
    (Rayleigh-Ritz). Products exchange border values of blocks of the cloud (see
    :mod:`blocked`), in jobs of as many products as move MOVED numbers; a job's files replace
    those of the job before, so the disk in use doesn't grow with the products; the driver gets sums of products of the columns, (2 (count + SPARE) + 3)^2
    numbers. Ends when the residuals ||S v - lambda v|| of all asked for are at most
    ``tolerance`` of the largest eigenvalue; ``rounds`` guards against an endless run and is
    an error. A coefficient's sign is that of an arbitrary direction; eigenvalues that lie
    together share a space, and so do their coefficients.

    Ids are unique; null coordinates count as 0; an empty cloud has no rows."""
    spark, schema = points.sparkSession, "n int, eigenvalue double, x double, y double, z double, residual double"
    with scratch(spark):
        off = stored(adj.where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w")), "off")
        both = off.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")).join(off.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("e"), F.count(F.lit(1)).alias("k")), "id", "full")
        both = stored(both.select("id", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("e", F.lit(0.0)).alias("e"), "k"), "degrees")
        # rows' discs: no eigenvalue lies below (what leaves a point - what enters it) / 2
        low, most = both.agg(F.min((F.col("d") - F.col("e")) / 2), F.max("k")).first()
        floor, even = min(0.0, low or 0.0), (most or 0) <= HUB
        if even:  # (W + W') / 2 by rows: neighbours' values are gathered, nothing is scattered
            off = off.select("src", "dst", F.col("w") / 2).union(off.select("dst", "src", F.col("w") / 2)).toDF("src", "dst", "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))
        held = points.select("id", *"xyz").join(both.select("id", "d"), "id", "left").fillna(0.0, ["d"])
        held = held.withColumns({f"s{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in "xyz"})
        graph = Graph(held, off, ("d", "sx", "sy", "sz"), size)
    steps: list[str] = []
    try:
        m, whole = min(graph.count, count + SPARE), graph.whole
        if not m:
            return spark.createDataFrame([], schema)
        scattered = not (whole or even)

        def renewed(rows: DataFrame) -> DataFrame:
            """The state stored, and the one before deleted."""
            rows = stored(rows, "basis")
            discard(spark, *steps)
            steps[:] = [rows._stored_at]
            return rows

        def noise(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
            """Numbers from -1 to 1 that depend on the id, the column and the seed."""
            with np.errstate(over="ignore"):
                z = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(k, dtype=np.uint64) + np.uint64(seed * k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            return z.astype(float) / 2.0**63 - 1

        def mid(block, v: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            """S v at a block's own points, and what it has for its border's if rows are scattered."""
            if even:
                return block.data["d"][:, None] * v - block.times(v, border), None
            mine, theirs = block.transposed(v)
            return block.data["d"][:, None] * v - (block.times(v, border) + mine) / 2, -theirs / 2

        def first(block) -> Outbox:
            v = noise(block.data["id"], m, 0)
            return Outbox(v, v)

        def product(rows: DataFrame) -> DataFrame:
            """V to [V, X, S V]."""

            def out(block, box) -> Outbox:
                own, theirs = mid(block, box.own, box.border)
                return Outbox(np.concatenate([box.own, *(block.data[f"s{c}"][:, None] for c in "xyz"), own], axis=1), scatter=theirs)

            def back(block, box) -> Outbox:
                return Outbox(np.concatenate([box.own[:, : m + 3], box.own[:, m + 3 :] + box.given], axis=1))

            made = graph.step(rows, out, m, m)
            return graph.step(made, back, 2 * m + 3, 0, m) if scattered else made

        def filtered_by(rows: DataFrame, turn: np.ndarray, low: float, high: float, degree: int, seed: int) -> DataFrame:
            """[V, X, S V] to p(S) V turn: the scaled Chebyshev polynomial of a degree that
            stays within 1 from ``low`` to ``high``."""
            centre, half = (low + high) / 2, (high - low) / 2

            def begin(block, box) -> Outbox:
                v = box.own[:, :m] @ turn
                if v.shape[1] < m:
                    v = np.concatenate([v, noise(block.data["id"], m - v.shape[1], seed)], axis=1)
                return alone(block, v) if whole else Outbox(v, v)

            def alone(block, v: np.ndarray) -> Outbox:
                before = np.zeros_like(v)
                for k in range(degree):
                    sv, _ = mid(block, v, np.zeros((0, m)))
                    v, before = next_of(v, before, sv, k), v
                return Outbox(v, v)

            def next_of(v: np.ndarray, before: np.ndarray, sv: np.ndarray, k: int) -> np.ndarray:
                new = (sv - centre * v) / half
                return 2 * new - before if k else new

            rows = graph.step(rows, begin, 2 * m + 3, 0)
            for k in range(0 if whole else degree):
                width = 2 * m if k else m  # [V, V before] but for the first

                def gathered(block, box, k=k) -> Outbox:
                    v = box.own[:, :m]
                    new = next_of(v, box.own[:, m:], mid(block, v, box.border)[0], k)
                    return Outbox(np.concatenate([new, v], axis=1) if k + 1 < degree else new, new)

                def out(block, box) -> Outbox:
                    own, theirs = mid(block, box.own[:, :m], box.border)
                    return Outbox(np.concatenate([box.own, own], axis=1), scatter=theirs)

                def back(block, box, k=k, width=width) -> Outbox:
                    v = box.own[:, :m]
                    new = next_of(v, box.own[:, m:width], box.own[:, width:] + box.given, k)
                    return Outbox(np.concatenate([new, v], axis=1) if k + 1 < degree else new, new)

                rows = graph.step(graph.step(rows, out, width, m), back, width + m, 0, m) if scattered else graph.step(rows, gathered, width, m)
                if (k + 1) % max(1, MOVED // (6 * m * graph.count)) == 0:
                    rows = renewed(rows)
            return rows

        rows, asked = renewed(product(graph.start(first))), min(count, m)
        for k in range(rounds):
            g = summed(rows, 2 * m + 3, lambda s: s.T @ s).reshape(2 * m + 3, -1)
            vv, vs, ss, vx = g[:m, :m], g[:m, m + 3 :], g[m + 3 :, m + 3 :], g[:m, m : m + 3]
            scale = 1 / np.sqrt(np.maximum(np.diag(vv), 1e-300))
            size_, axes = np.linalg.eigh(vv * np.outer(scale, scale))
            good = size_ > 1e-11 * size_[-1]
            base = scale[:, None] * axes[:, good] / np.sqrt(size_[good])
            values, inner = np.linalg.eigh(base.T @ ((vs + vs.T) / 2) @ base)
            order = np.argsort(-np.abs(values), kind="stable")
            values, turn = values[order], base @ inner[:, order]
            left = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, ss, turn) - 2 * values * np.einsum("ij,ik,kj->j", turn, (vs + vs.T) / 2, turn) + values**2 * np.einsum("ij,ik,kj->j", turn, vv, turn), 0))
            top = max(float(np.abs(values[0])), 1e-300)
            if len(values) >= asked and (m == graph.count or left[:asked].max() <= tolerance * top):
                coef = turn.T @ vx
                out = [(n, float(values[n]), *map(float, coef[n]), float(left[n])) for n in range(asked)]
                return spark.createDataFrame(out, schema)
            high = float(np.abs(values[-1]))
            low = floor if -floor < high else -high  # all of larger magnitude are positive, or both ends grow
            x = (top - (low + high) / 2) / max((high - low) / 2, 1e-300)
            degree = int(np.clip(np.arccosh(SPREAD) / np.arccosh(max(x, 1 + 1e-12)), 1, DEGREE))
            rows = renewed(product(filtered_by(rows, turn, low, high, degree, k + 1)))
        raise RuntimeError("the subspace doesn't converge")
    finally:
        graph.close()
        discard(spark, *steps)
