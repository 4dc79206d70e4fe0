"""Feature-preserving smoothing: linear systems on the graph of a cloud.

The graph is cut into blocks that stay where they are (see :mod:`blocked`); a step works
within the blocks and exchanges the state and the values at their borders. A graph of one
block is solved in one task's step; larger ones take several steps a job.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stored
from . import sampling
from .blocked import Block, Graph, Inbox, Outbox, largest, summed

#: Steps between two writes of the state, and sweeps within a block in one step.
PER_WRITE, INNER = 4, 50


def _degrees(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``points`` with ``wsum`` and ``wsent``: what leaves and what enters each by ``edges``."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("wsum"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("wsent"))
    return points.join(out, "id", "left").join(back, "id", "left").fillna(0.0, ["wsum", "wsent"])


def _xyz(block: Block) -> np.ndarray:
    return np.stack([block.data[f"p{c}"] for c in "xyz"], axis=1)


def smooth(points: DataFrame, adj: DataFrame, mask: DataFrame | None, gamma: float = 0.1, feature_weight: float = 1.0, data_weight: float = 0.8, tolerance: float = 1e-12, sweeps: int = 10_000, size: int | None = None) -> DataFrame:
    """Solves (gamma L + (1-gamma)(feature_weight S + data_weight I)) X = (the same weights) P
    by Jacobi sweeps; S marks ``feature`` rows of ``mask`` (none without a mask).

    Rows of L sum to 0 with no positive entry beside the diagonal, so the matrix is
    diagonally dominant and the sweeps converge, in whatever order blocks and points take
    them: a step sweeps each block INNER times against its border. Steps end when no
    coordinate moves by more than ``tolerance`` in one. ``sweeps`` only guards against an
    endless run: it is an error to reach it. Points without edges stay where they are."""
    marked = points.select("id", *"xyz", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    marked = marked.withColumn("feature", F.lit(False)) if mask is None else marked.join(mask.select("id", "feature"), "id", "left")
    m = (1 - gamma) * (F.when(F.col("feature"), feature_weight).otherwise(0.0) + data_weight)
    e = stored(adj.where("src <> dst").select("src", "dst", "w"), "edges")
    graph = Graph(_degrees(marked.withColumn("m", m), e), e, ("px", "py", "pz", "m", "wsum"), size)
    whole = graph.whole

    def sweep(block: Block, box: Inbox) -> Outbox:
        x = start = box.own[:, :3]
        m, p, own = block.data["m"][:, None], _xyz(block), block.data["wsum"][:, None]
        for _ in range(sweeps if whole else INNER):
            last, x = x, (m * p + gamma * block.times(x, box.border)) / (m + gamma * own)
            moved = np.abs(x - last).max(axis=1)
            if np.fmax.reduce(moved, initial=0) <= tolerance / 2:
                break
        if not whole:
            moved = np.abs(x - start).max(axis=1)
        return Outbox(np.concatenate([x, moved[:, None]], axis=1), x)

    try:
        rows = graph.start(lambda b: Outbox(np.concatenate([_xyz(b), np.zeros((b.n, 1))], axis=1), _xyz(b)))
        for _ in range(1 if whole else -(-sweeps // PER_WRITE)):
            for _ in range(1 if whole else PER_WRITE):
                rows = graph.step(rows, sweep, 4, 3)
            rows = stored(rows, "sweep")
            moved = largest(rows, 4, lambda s: np.fmax.reduce(s[:, 3], initial=0))
            if not len(moved) or moved[0] <= tolerance:
                return stored(graph.state(rows, ["x", "y", "z"], 4), "smooth")
        raise RuntimeError("the sweeps don't converge")
    finally:
        graph.close()


def smooth_squared(points: DataFrame, adj: DataFrame, mask: DataFrame | None = None, gamma: float = 0.05, tolerance: float = 1e-9, steps: int = 10_000, size: int | None = None) -> DataFrame:
    """Solves (gamma L'L + (1-gamma)(S + I)) X = (1-gamma)(S + I) P by Chebyshev iteration.

    L'L isn't diagonally dominant, so Jacobi isn't safe. The eigenvalues lie between the least
    weight of the data and the bound that the row and column sums of L give, so the steps need
    no inner products. Steps end when the residual's norm is at most ``tolerance``; it is an
    error to reach ``steps``. Without a mask S is 0."""
    s = F.lit(1.0) if mask is None else F.when(F.col("feature"), 2.0).otherwise(1.0)
    base = points.select("id", *"xyz", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    base = base if mask is None else base.join(mask.select("id", "feature"), "id", "left")
    e = stored(adj.where("src <> dst").select("src", "dst", "w"), "edges")
    held = stored(_degrees(base.withColumn("m", (1 - gamma) * s), e), "base")
    ends = held.agg(F.min("m").alias("low"), F.max("m").alias("high"), F.max("wsum").alias("row"), F.max(F.col("wsum") + F.col("wsent")).alias("col")).first()
    if ends.low is None:
        return points.select("id", "x", "y", "z")
    low, high = ends.low, ends.high + gamma * 2 * ends.row * ends.col
    centre, half = (high + low) / 2, max((high - low) / 2, 1e-12 * high)
    graph = Graph(held, e, ("px", "py", "pz", "m", "wsum"), size)
    whole = graph.whole

    def share(block: Block, d: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A block's share of A d, at its own points and at its border's."""
        own = block.data["wsum"][:, None]
        u = own * d - block.times(d, border)
        mine, theirs = block.transposed(u)
        return gamma * (own * u - mine) + block.data["m"][:, None] * d, -gamma * theirs

    def out(block: Block, box: Inbox) -> Outbox:
        y, theirs = share(block, box.own[:, 6:9], box.border)
        return Outbox(np.concatenate([box.own, y], axis=1), scatter=theirs)

    def begin(p: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x, r, d from x = P and A P."""
        r = m * p - y
        return np.concatenate([p, r, r / centre], axis=1)

    def move(state: np.ndarray, y: np.ndarray, rho: float) -> tuple[np.ndarray, float]:
        x, r, d = state[:, :3] + state[:, 6:9], state[:, 3:6] - y, state[:, 6:9]
        new = 1 / (2 * centre / half - rho)
        return np.concatenate([x, r, new * rho * d + 2 * new / half * r], axis=1), new

    def alone(block: Block) -> Outbox:
        p, none = _xyz(block), np.zeros((0, 3))
        state, rho = begin(p, block.data["m"][:, None], share(block, p, none)[0]), half / centre
        for _ in range(steps):
            if np.sqrt(np.nansum(state[:, 3:6] ** 2, axis=0)).max() <= tolerance:
                break
            state, rho = move(state, share(block, state[:, 6:9], none)[0], rho)
        return Outbox(state)

    try:
        if whole:
            rows = stored(graph.start(alone), "state")
        else:
            rows = graph.start(lambda b: Outbox(np.concatenate([_xyz(b), np.zeros((b.n, 3)), _xyz(b)], axis=1), _xyz(b)))
            rows = graph.step(rows, out, 9, 3)
            rows = graph.step(rows, lambda b, box: Outbox(s := begin(_xyz(b), b.data["m"][:, None], box.own[:, 9:] + box.given), s[:, 6:9]), 12, 0, 3)
        rho, taken = half / centre, 0
        while True:
            norm = summed(rows, 9, lambda s: np.nansum(s[:, 3:6] ** 2, axis=0))
            if not len(norm) or np.sqrt(norm.max()) <= tolerance * np.sqrt(graph.count if whole else 1):
                return stored(graph.state(rows, ["x", "y", "z"], 9), "smooth")
            if taken >= steps or whole:
                raise RuntimeError("the iteration doesn't converge")
            for _ in range(PER_WRITE):

                def back(block: Block, box: Inbox, rho: float = rho) -> Outbox:
                    state, _ = move(box.own[:, :9], box.own[:, 9:] + box.given, rho)
                    return Outbox(state, state[:, 6:9])

                rows = graph.step(graph.step(rows, out, 9, 3), back, 12, 0, 3)
                rho, taken = 1 / (2 * centre / half - rho), taken + 1
            rows = stored(rows, "state")
    finally:
        graph.close()


def smooth_mean(points: DataFrame, adj: DataFrame, alpha: float = 0.01, tolerance: float = 1e-9, steps: int = 10_000, size: int | None = None) -> DataFrame:
    """Solves ((L + L')/2 + alpha I) X = alpha P by conjugate gradients: the least of
    tr(X'LX) + alpha |X - P|^2 where that has one.

    The matrix of a directed graph need not be definite; where a step finds that it isn't
    (``alpha`` is too small), that is an error. Steps end when the residual's norm is at most
    ``tolerance`` on every axis; it is an error to reach ``steps``. A graph of one block is
    solved within it; otherwise a step is one job, and the driver gets nine sums of it."""
    e = stored(adj.where("src <> dst").select("src", "dst", "w"), "edges")
    held = points.select("id", *"xyz", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    graph = Graph(_degrees(held, e), e, ("px", "py", "pz", "wsum"), size)
    whole = graph.whole

    def share(block: Block, v: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine, theirs = block.transposed(v)
        return (block.data["wsum"][:, None] + alpha) * v - (block.times(v, border) + mine) / 2, -theirs / 2

    def lengths(rr: np.ndarray, vy: np.ndarray) -> np.ndarray:
        if (vy[rr > tolerance**2] <= 0).any():
            raise ArithmeticError("the system isn't definite: alpha is too small")
        return np.where(vy > 0, rr / np.where(vy > 0, vy, 1), 0)

    def alone(block: Block) -> Outbox:
        p, none = _xyz(block), np.zeros((0, 3))
        x, r = p, alpha * p - share(block, p, none)[0]
        v, rr = r, np.nansum(r * r, axis=0)
        for _ in range(steps):
            if rr.max() <= tolerance**2:
                return Outbox(np.concatenate([x, r, v], axis=1))
            y, _ = share(block, v, none)
            a = lengths(rr, np.nansum(v * y, axis=0))
            x, r, last = x + a * v, r - a * y, rr
            rr = np.nansum(r * r, axis=0)
            v = r + np.where(last > 0, rr / np.where(last > 0, last, 1), 0) * v
        raise RuntimeError("the conjugate gradients don't converge")

    def out(block: Block, box: Inbox) -> Outbox:
        y, theirs = share(block, box.own[:, 6:9], box.border)
        return Outbox(np.concatenate([box.own, y], axis=1), scatter=theirs)

    def product(rows: DataFrame) -> DataFrame:
        """(x, r, v) with A v."""

        def back(block: Block, box: Inbox) -> Outbox:
            return Outbox(np.concatenate([box.own[:, :9], box.own[:, 9:] + box.given], axis=1))

        return graph.step(graph.step(rows, out, 9, 3), back, 12, 0, 3)

    def sums(s: np.ndarray) -> np.ndarray:
        r, v, y = s[:, 3:6], s[:, 6:9], s[:, 9:]
        return np.nansum(np.stack([r * r, v * y, r * y, y * y]), axis=1)

    try:
        if whole:
            return stored(graph.state(stored(graph.start(alone), "state"), ["x", "y", "z"], 9), "smooth")
        zero = lambda b: np.zeros((b.n, 3))
        rows = stored(product(graph.start(lambda b: Outbox(np.concatenate([_xyz(b), zero(b), _xyz(b)], axis=1), _xyz(b)))), "state")

        def first(block: Block, box: Inbox) -> Outbox:
            r = alpha * _xyz(block) - box.own[:, 9:]
            return Outbox(np.concatenate([box.own[:, :3], r, r], axis=1), r)

        rows = stored(product(graph.step(rows, first, 12, 0)), "state")
        for _ in range(steps):
            rr, vy, ry, yy = summed(rows, 12, sums).reshape(4, 3)
            if rr.max() <= tolerance**2:
                return stored(graph.state(rows, ["x", "y", "z"], 12), "smooth")
            a = lengths(rr, vy)
            b = np.where(rr > 0, np.maximum(rr - 2 * a * ry + a * a * yy, 0) / np.where(rr > 0, rr, 1), 0)

            def move(block: Block, box: Inbox, a: np.ndarray = a, b: np.ndarray = b) -> Outbox:
                x, r, v, y = (box.own[:, k : k + 3] for k in (0, 3, 6, 9))
                r = r - a * y
                return Outbox(np.concatenate([x + a * v, r, r + b * v], axis=1), r + b * v)

            rows = stored(product(graph.step(rows, move, 12, 0)), "state")
        raise RuntimeError("the conjugate gradients don't converge")
    finally:
        graph.close()


def simplify(points: DataFrame, adj: DataFrame, scores: DataFrame, voxel: float, gamma: float = 0.1) -> DataFrame:
    """(part, cx, cy, cz, n, x, y, z): feature points thinned at half a voxel, with the
    smoothed cloud thinned at a voxel."""
    mask = stored(sampling.feature_band(scores), "mask")
    soft = smooth(points, adj, mask, gamma)
    sharp = points.join(mask.where("feature").select("id"), "id", "left_semi")
    one = sampling.voxel_downsample(sharp, voxel * 0.5).withColumn("part", F.lit("feature"))
    two = sampling.voxel_downsample(soft, voxel).withColumn("part", F.lit("smooth"))
    return one.unionByName(two)
