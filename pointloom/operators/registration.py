"""Rigid transforms, registration by iterative closest points, and pose errors.

An iteration is one nearest-neighbour join and one aggregate to a fixed number of sums; the
driver only solves 3 x 3 or 6 x 6 systems. Clouds are never changed in place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spatial
from ..functions.lineage import bucketed, stored
from . import neighbors, partition

Matrix = list[list[float]]
IDENTITY: Matrix = np.eye(4).tolist()


def axis_angle(axis: list[float], theta: float, t: list[float] = (0.0, 0.0, 0.0)) -> Matrix:
    """Counter-clockwise rotation by theta about an axis, then a translation."""
    a = np.asarray(axis, float)
    norm = np.linalg.norm(a)
    if norm == 0:
        raise ValueError("the axis has no direction")
    x, y, z = a / norm
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    m = np.eye(4)
    m[:3, :3] = np.eye(3) + math.sin(theta) * k + (1 - math.cos(theta)) * k @ k
    m[:3, 3] = t
    return m.tolist()


def z_rotation(angle: float, t: list[float] = (0.0, 0.0, 0.0)) -> Matrix:
    return axis_angle([0, 0, 1], angle, t)


def random_pose(seed: int, reach: float = 100.0) -> Matrix:
    """Angle in [0, pi/2] about a Gaussian axis, translation in a cube."""
    rng = np.random.default_rng(seed)
    return axis_angle(rng.normal(size=3).tolist(), rng.uniform(0, math.pi / 2), rng.uniform(-reach, reach, 3).tolist())


def inverse(matrix: Matrix) -> Matrix:
    m = np.asarray(matrix, float)
    out = np.eye(4)
    out[:3, :3] = m[:3, :3].T
    out[:3, 3] = -m[:3, :3].T @ m[:3, 3]
    return out.tolist()


def product(a: Matrix, b: Matrix) -> Matrix:
    return (np.asarray(a) @ np.asarray(b)).tolist()


def transform(points: DataFrame, matrix: Matrix) -> DataFrame:
    rest = [c for c in points.columns if c not in spatial.XYZ]
    return points.select(*rest, *spatial.moved(matrix))


def rotation_angle(matrix: Matrix) -> float:
    """Radians; rounding beyond [-1, 1] is clamped."""
    return math.acos(max(-1.0, min(1.0, (float(np.trace(np.asarray(matrix)[:3, :3])) - 1) / 2)))


def pose_error(found: Matrix, truth: Matrix) -> dict[str, float]:
    """Two conventions: of inv(found) truth, and of the rotation found inv(truth) with the
    difference of the translations."""
    delta = np.asarray(product(inverse(found), truth))
    r = np.asarray(found)[:3, :3] @ np.asarray(truth)[:3, :3].T
    apart = np.asarray(found)[:3, 3] - np.asarray(truth)[:3, 3]
    return {
        "rotation_error_deg": math.degrees(rotation_angle(delta.tolist())),
        "translation_error": float(np.linalg.norm(delta[:3, 3])),
        "rotation_error_rad": rotation_angle(r.tolist()),
        "translation_difference": float(np.linalg.norm(apart)),
    }


def correspondences(source: DataFrame, target: DataFrame, distance: float) -> DataFrame:
    """Each source point with its nearest target point within ``distance``: edges."""
    return neighbors.hybrid(source, distance, 1, target)


SUMS = [("n", lambda: F.count(F.lit(1)))] + [(f"{p}{c}", lambda p=p, c=c: F.sum(f"{p}{c}")) for p in "st" for c in "xyz"] + [(f"h{a}{b}", lambda a=a, b=b: F.sum(F.col(f"s{a}") * F.col(f"t{b}"))) for a in "xyz" for b in "xyz"] + [("d2", lambda: F.sum("d2"))]


def cross_covariance(pairs: DataFrame) -> DataFrame:
    """One row of sums: count, both coordinate sums, nine products, squared distances."""
    return pairs.agg(*[f().alias(n) for n, f in SUMS])


def kabsch(row) -> Matrix:
    """The rigid motion that the sums of :func:`cross_covariance` imply."""
    if not row["n"]:
        return IDENTITY
    n = row["n"]
    s, t = (np.array([row[f"{p}{c}"] for c in "xyz"]) / n for p in "st")
    h = np.array([[row[f"h{a}{b}"] for b in "xyz"] for a in "xyz"]) / n - np.outer(s, t)
    u, _, v = np.linalg.svd(h)
    flip = np.diag([1, 1, np.sign(np.linalg.det(v.T @ u.T)) or 1])
    m = np.eye(4)
    m[:3, :3] = v.T @ flip @ u.T
    m[:3, 3] = t - m[:3, :3] @ s
    return m.tolist()


def _small_motion(a: np.ndarray, b: np.ndarray) -> Matrix:
    """The motion of a solved 6 x 6 system (rotation vector, translation)."""
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    angle = float(np.linalg.norm(x[:3]))
    return axis_angle((x[:3] / angle).tolist() if angle else [0, 0, 1], angle, x[3:].tolist())


#: Columns of the target that a method reads.
NEEDS = {"point": (), "plane": ("nx", "ny", "nz"), "color": ("nx", "ny", "nz", "gx", "gy", "gz", "i")}


def step_sums(pairs: DataFrame, method: str = "point", color_share: float = 0.032) -> DataFrame:
    """One row of the sums that a step of ICP is solved from.

    point: :func:`cross_covariance`. Others: n, d2, the upper triangle of J'J (c0 .. c20) and
    -J'r (c21 .. c26) of the rotation vector and translation. plane: residuals along the
    target's normal (q-columns of the pairs). color: these, and differences between the
    source's intensity ``si`` and the target's on its tangent plane."""
    if method == "point":
        return cross_covariance(pairs)
    s, t, nv = ([F.col(f"{p}{c}") for c in "xyz"] for p in ("s", "t", "qn"))

    def jacobian(v: list) -> list:
        return [s[1] * v[2] - s[2] * v[1], s[2] * v[0] - s[0] * v[2], s[0] * v[1] - s[1] * v[0], *v]

    gap = sum(((a - b) * c for a, b, c in zip(s, t, nv, strict=True)), F.lit(0.0))
    terms = [(jacobian(nv), gap)]
    if method == "color":
        g = [F.col(f"qg{c}") for c in "xyz"]
        along = [a - gap * c for a, c in zip(s, nv, strict=True)]
        shade = F.col("qi") + sum((v * (a - b) for v, a, b in zip(g, along, t, strict=True)), F.lit(0.0)) - F.col("si")
        slope = sum((v * c for v, c in zip(g, nv, strict=True)), F.lit(0.0))
        flat = [v - slope * c for v, c in zip(g, nv, strict=True)]
        w, v = math.sqrt(color_share), math.sqrt(1 - color_share)
        terms = [([w * x for x in terms[0][0]], w * gap), ([v * x for x in jacobian(flat)], v * shade)]
    a = [sum((j[p] * j[q] for j, _ in terms), F.lit(0.0)) for p in range(6) for q in range(p, 6)]
    b = [sum((-j[p] * r for j, r in terms), F.lit(0.0)) for p in range(6)]
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("d2"), *[F.sum(c).alias(f"c{k}") for k, c in enumerate(a + b)])


def _solved(row, method: str) -> Matrix:
    """The motion of a row of :func:`step_sums`."""
    if method == "point":
        return kabsch(row)
    m = np.zeros((6, 6))
    for k, (p, q) in enumerate((p, q) for p in range(6) for q in range(p, 6)):
        m[p, q] = m[q, p] = row[f"c{k}"] or 0.0
    return _small_motion(m, np.array([row[f"c{k}"] or 0.0 for k in range(21, 27)]))


#: Points of a cell from which on the leaves of a partition are searched instead of cells.
FULL = 16


@contextmanager
def matcher(target: DataFrame, distance: float, method: str = "point", held: partition.Held | None = None) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function from a source cloud to its :func:`correspondences` with the target's columns
    for the method (q...) and, for colour, the source's intensity ``si``.

    The target is stored once: bucketed by cells of ``distance``, so that every call moves the
    source only, or, where cells have more than FULL points, in the leaves of a partition, whose
    number of distances doesn't grow with the density. ``held``: the target is there already,
    with the method's columns."""
    extra = list(NEEDS[method])
    shade = ["i"] if method == "color" else []

    def source_side(source: DataFrame) -> DataFrame:
        return source.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(F.col("id").alias("src"), *[F.col(c).cast("double").alias(f"s{c}") for c in (*"xyz", *shade)])

    known = target.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    if held or not neighbors._crowded(known, distance, min(FULL, neighbors.DENSE), ()).isEmpty():
        leaves, hot = held or partition.Held(target, tuple(extra)), []

        def search(source: DataFrame) -> DataFrame:
            if not hot:  # a step moves the source a little, so the first one's crowds will do
                hot.append(leaves.crowds(source, distance))
            return leaves.within(source, distance, tuple(shade), hot[0])

        yield search
        return
    cells = known.select(F.col("id").alias("dst"), *[F.col(c).cast("double").alias(f"t{c}") for c in "xyz"], *[F.col(c).alias(f"q{c}") for c in extra])
    with bucketed(cells.select("*", *spatial.cell(distance, prefix="t")), ["cx", "cy", "cz"], "target") as near_:

        def meet(source: DataFrame) -> DataFrame:
            met = neighbors._probes(source_side(source), distance, "s").join(near_, ["cx", "cy", "cz"]).withColumn("d2", spatial.sq_dist("s", "t"))
            near = met.where(F.col("d2") < F.lit(distance * distance))
            best = F.min(F.struct("d2", "dst", *[f"t{c}" for c in "xyz"], *[f"q{c}" for c in extra])).alias("m")
            return near.groupBy("src", *[f"s{c}" for c in (*"xyz", *shade)]).agg(best).select("src", *[f"s{c}" for c in (*"xyz", *shade)], "m.*")

        yield meet


def icp(source: DataFrame, target: DataFrame, distance: float = 0.1, start: Matrix | None = None, iterations: int = 100, method: str = "point", tolerance: float = 1e-6, color_share: float = 0.032, held: partition.Held | None = None) -> tuple[Matrix, float, float]:
    """(transform, fitness, inlier rmse) of source onto target.

    point: closed-form motion of the pairs. plane: least squares along the target's normals
    (columns nx, ny, nz). color: plane plus intensity differences along the target's colour
    gradient (columns gx, gy, gz and intensity i on the target, i on the source). Stops
    when fitness and rmse change by less than ``tolerance``. A step is one job: the source's
    probes meet the stored target, and the driver gets a row of sums. ``held``: see
    :func:`matcher`."""
    if method not in NEEDS:
        raise ValueError(f"unknown method {method!r}")
    total = np.asarray(start or IDENTITY, float)
    n = source.count()
    last = (-1.0, -1.0)
    fitness = rmse = 0.0
    with matcher(target, distance, method, held) as pairs_of:
        for _ in range(iterations):
            row = step_sums(pairs_of(transform(source, total.tolist())), method, color_share).first()
            count, d2 = row["n"], row["d2"] or 0.0
            fitness, rmse = (count / n if n else 0.0), (math.sqrt(d2 / count) if count else 0.0)
            if abs(fitness - last[0]) < tolerance and abs(rmse - last[1]) < tolerance or not count:
                break
            last = (fitness, rmse)
            total = np.asarray(_solved(row, method)) @ total
    return total.tolist(), fitness, rmse


def color_gradients(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``points`` (id, x, y, z, i, nx, ny, nz) with gx, gy, gz: the least-squares gradient of
    intensity over each neighbourhood in the tangent plane."""

    held = edges.select("src", "dst", *[(F.col(f"t{c}") - F.col(f"s{c}")).alias(f"d{c}") for c in "xyz"])
    near = held.join(points.select(F.col("id").alias("dst"), F.col("i").alias("it")), "dst").join(points.select(F.col("id").alias("src"), "i", "nx", "ny", "nz"), "src")
    dot = F.col("dx") * F.col("nx") + F.col("dy") * F.col("ny") + F.col("dz") * F.col("nz")
    flat = near.select("src", "nx", "ny", "nz", (F.col("it") - F.col("i")).alias("di"), *[(F.col(f"d{c}") - dot * F.col(f"n{c}")).alias(f"u{c}") for c in "xyz"])
    sums = flat.groupBy("src", "nx", "ny", "nz").agg(*[F.sum(F.col(f"u{a}") * F.col(f"u{b}")).alias(f"m{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")], *[F.sum(F.col(f"u{c}") * F.col("di")).alias(f"b{c}") for c in "xyz"])

    @F.pandas_udf("gx double, gy double, gz double")
    def solve(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series, nx: pd.Series, ny: pd.Series, nz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
        v = np.stack([nx, ny, nz], -1)
        m = m + v[:, :, None] * v[:, None, :]  # the normal direction gets no gradient
        g = np.einsum("nij,nj->ni", np.linalg.pinv(m), np.stack([bx, by, bz], -1)) if len(m) else np.zeros((0, 3))
        return pd.DataFrame(g, columns=["gx", "gy", "gz"])

    g = sums.select(F.col("src").alias("id"), solve("mxx", "myy", "mzz", "mxy", "mxz", "myz", "bx", "by", "bz", "nx", "ny", "nz").alias("g")).select("id", "g.*")
    return points.join(g, "id", "left").fillna(0.0, ["gx", "gy", "gz"])


def two_stage_icp(source: DataFrame, target: DataFrame, distance: float = 0.1, overlap: float = 0.15, start: Matrix | None = None, iterations: int = 100) -> tuple[Matrix, float, float]:
    """ICP, again on the points that both clouds have within ``overlap``; T = T2 T1."""
    first, _, _ = icp(source, target, distance, start, iterations)
    moved = stored(transform(source, first), "moved")
    near = moved.join(neighbors.hybrid(moved, overlap, 1, target).select(F.col("src").alias("id")), "id", "left_semi")
    back = target.join(neighbors.hybrid(target, overlap, 1, moved).select(F.col("src").alias("id")), "id", "left_semi")
    second, fitness, rmse = icp(stored(near, "near"), stored(back, "back"), distance, None, iterations)
    return product(second, first), fitness, rmse


def evaluate(source: DataFrame, target: DataFrame, threshold: float = 0.2, held: partition.Held | None = None) -> DataFrame:
    """One row (fitness, inlier_rmse): share of source points with a target point nearer
    than ``threshold``, and the root mean square of their distances (0 without any). ``held``:
    the target in its leaves."""
    pairs = held.within(source, threshold, hot=held.crowds(source, threshold)) if held else correspondences(source, target, threshold)
    hits = pairs.agg(F.count(F.lit(1)).alias("hits"), F.avg("d2").alias("mean"))
    return hits.crossJoin(source.agg(F.count(F.lit(1)).alias("n"))).select(F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("fitness"), F.coalesce(F.sqrt("mean"), F.lit(0.0)).alias("inlier_rmse"))


def solve_matches(matches: DataFrame, rounds: int = 20, scale: float | None = None) -> Matrix:
    """The rigid motion of matched points (sx.. to tx..) by iteratively reweighted closed-form
    solutions: weight (scale / (scale + residual^2))^2, so wrong matches fade out. Without a
    ``scale`` it is the square of 1.4826 times the median residual of each round (a robust
    deviation), so the unit of the coordinates doesn't matter."""
    m = IDENTITY
    for _ in range(rounds):
        moved = [sum((F.lit(float(r[k])) * F.col(f"s{c}") for k, c in enumerate("xyz")), F.lit(float(r[3]))) for r in m[:3]]
        r2 = sum(((a - F.col(f"t{c}")) ** 2 for a, c in zip(moved, "xyz", strict=True)), F.lit(0.0))
        held, size = matches.withColumn("r2", r2), scale
        if size is None:
            ends = held.agg(F.percentile_approx("r2", 0.5, 10_000).alias("mid"), F.max("r2").alias("top")).first()
            size = 1.4826**2 * (ends.mid or 0.0) or 1e-12 * (ends.top or 0.0) or 1.0
        held = held.withColumn("w", (F.lit(size) / (F.lit(size) + F.col("r2"))) ** 2)
        sums = [F.sum("w").alias("n")] + [F.sum(F.col("w") * F.col(f"{p}{c}")).alias(f"{p}{c}") for p in "st" for c in "xyz"] + [F.sum(F.col("w") * F.col(f"s{a}") * F.col(f"t{b}")).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"]
        new = kabsch(held.agg(*sums).first())
        if np.abs(np.asarray(new) - np.asarray(m)).max() < 1e-9:
            return new
        m = new
    return m


def ransac_matches(matches: DataFrame, distance: float, tries: int = 2000, similar: float = 0.9, confidence: float = 0.999, seed: int = 0, batch: int = 64) -> tuple[Matrix, int]:
    """(motion, matches within ``distance`` under it) of matched points of which many are wrong.

    Triples of matches are drawn by hashes of their row and the seed (a bounded draw of 3 *
    ``tries``); a triple whose edges differ in length between the clouds by more than the share
    1 - ``similar`` can't be right and is dropped. The motions of ``batch`` triples at a time
    are scored in one aggregate over all matches (its terms are columns, so nothing is
    multiplied out), until a right triple has been drawn with ``confidence`` at the best share
    of inliers so far. The best motion (ties: the earlier) is solved again from all its inliers
    until they no longer change. Fewer than three matches, or no possible triple, give the
    identity and no inliers. Rows are matches sx, sy, sz, tx, ty, tz; null ones don't count."""
    cols = [f"{p}{c}" for p in "st" for c in "xyz"]
    held = stored(matches.select(*cols).dropna(), "matches")
    n = held.count()
    order = F.xxhash64(*cols, F.lit(seed))
    drawn = np.array([tuple(r) for r in held.orderBy(order, *cols).limit(3 * tries).collect()], float).reshape(-1, 2, 3)  # bounded
    if n < 3:
        return IDENTITY, 0
    rng = np.random.default_rng(seed)
    triples = np.array([rng.choice(len(drawn), 3, replace=False) for _ in range(tries)])
    points = drawn[triples]  # try, corner, cloud, axis
    sides = np.linalg.norm(points - np.roll(points, 1, axis=1), axis=3)
    fits = (sides.min(axis=2) >= similar * sides.max(axis=2)).all(axis=1) & (sides.min(axis=(1, 2)) > 0)
    motions = []
    for p in points[fits]:
        s, t = p[:, 0], p[:, 1]
        row = {"n": 3, **{f"s{c}": s[:, k].sum() for k, c in enumerate("xyz")}, **{f"t{c}": t[:, k].sum() for k, c in enumerate("xyz")}}
        row |= {f"h{a}{b}": float(s[:, i] @ t[:, j]) for i, a in enumerate("xyz") for j, b in enumerate("xyz")}
        motions.append(kabsch(row))

    def gap(m: Matrix):
        moved = [sum((F.lit(float(r[k])) * F.col(f"s{c}") for k, c in enumerate("xyz")), F.lit(float(r[3]))) for r in m[:3]]
        return sum(((a - F.col(f"t{c}")) * (a - F.col(f"t{c}")) for a, c in zip(moved, "xyz", strict=True)), F.lit(0.0))

    best, hits, seen = IDENTITY, 0, np.flatnonzero(fits)
    for at in range(0, len(motions), batch):
        some = motions[at : at + batch]
        counts = held.agg(*[F.count(F.when(gap(m) < distance * distance, 1)).alias(f"m{k}") for k, m in enumerate(some)]).first()
        k = int(np.argmax(counts))
        if counts[k] > hits:
            best, hits = some[k], int(counts[k])
        share = (hits / n) ** 3
        if hits and (share >= 1 or seen[min(at + batch, len(motions)) - 1] + 1 >= math.log(1 - confidence) / math.log(1 - share)):
            break
    for _ in range(20):
        inside = held.where(gap(best) < distance * distance)
        new = kabsch(cross_covariance(inside.withColumn("d2", gap(best))).first())
        count = held.where(gap(new) < distance * distance).count()
        if count < hits or np.abs(np.asarray(new) - np.asarray(best)).max() < 1e-12:
            break
        best, hits = new, count
    return best, hits


def feature_ransac(source: DataFrame, target: DataFrame, distance: float, feature: str = "feature", tries: int = 2000, seed: int = 0) -> tuple[Matrix, int]:
    """:func:`ransac_matches` of every source row and its nearest target row by descriptor."""
    pairs = neighbors.feature_match(source, target, feature)
    s = source.select(F.col("id").alias("id0"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    t = target.select(F.col("id").alias("id1"), *[F.col(c).alias(f"t{c}") for c in "xyz"])
    return ransac_matches(pairs.join(s, "id0").join(t, "id1"), distance, tries, seed=seed)


def coarse_registration(source: DataFrame, target: DataFrame, feature: str = "feature", subsample: int = -1) -> Matrix:
    """Registration from precomputed descriptors: nearest match in feature space for every
    source row, then the robust solution. Clouds have x, y, z and the feature array."""
    pairs = neighbors.feature_match(source, target, feature, subsample=subsample)
    s = source.select(F.col("id").alias("id0"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    t = target.select(F.col("id").alias("id1"), *[F.col(c).alias(f"t{c}") for c in "xyz"])
    return solve_matches(stored(pairs.join(s, "id0").join(t, "id1"), "matches"))


def pca(points: DataFrame) -> DataFrame:
    """One row: centroid (mx, my, mz) and sample covariance (xx .. yz)."""
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    return points.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_samp(p[0], p[1]).alias(p) for p in pairs])


def pca_align(source: DataFrame, target: DataFrame) -> Matrix:
    """Centroid shift and rotation of the main axis onto the target's; opposite axes are
    turned by half a turn."""

    def main(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        r = pca(points).first()
        m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
        return np.array([r.mx, r.my, r.mz]), np.linalg.eigh(m)[1][:, -1]

    (c1, v1), (c2, v2) = main(source), main(target)
    axis, cosine = np.cross(v1, v2), float(np.clip(v1 @ v2, -1, 1))
    if np.linalg.norm(axis) < 1e-8:
        other = np.eye(3)[np.abs(v1).argmin()]
        turn = np.eye(4) if cosine > 0 else np.asarray(axis_angle(np.cross(v1, other).tolist(), math.pi))
    else:
        turn = np.asarray(axis_angle(axis.tolist(), math.acos(cosine)))
    turn[:3, 3] = c2 - turn[:3, :3] @ c1
    return turn.tolist()


def plane_inliers(points: DataFrame, plane: tuple[float, float, float, float], threshold: float = 0.1) -> DataFrame:
    a, b, c, d = map(float, plane)
    gap = F.abs(F.lit(a) * F.col("x") + F.lit(b) * F.col("y") + F.lit(c) * F.col("z") + F.lit(d)) / math.sqrt(a * a + b * b + c * c)
    return points.withColumn("distance", gap).where(F.col("distance") < threshold)


def ransac_planes(points: DataFrame, threshold: float = 0.1, tries: int = 100, stop_below: int = 20_000, most: int = 10, seed: int = 0) -> list[dict]:
    """Planes of ever smaller support: each the best of ``tries`` seeded three-point
    candidates (scored in one pass over the points), whose inliers are then removed. Ends
    with fewer than ``stop_below`` points or inliers, or after ``most`` planes."""
    rng, out, left = np.random.default_rng(seed), [], points
    for _ in range(most):
        n = left.count()
        if n < max(3, stop_below):
            break
        drawn = [(r.x, r.y, r.z) for r in left.orderBy(F.xxhash64("id", F.lit(int(rng.integers(2**31))))).limit(3 * tries).select("x", "y", "z").toLocalIterator()]
        planes = []
        for k in range(0, len(drawn) - 2, 3):
            p, q, r = map(np.array, drawn[k : k + 3])
            normal = np.cross(q - p, r - p)
            size = np.linalg.norm(normal)
            if size > 1e-12:
                normal = normal / size
                planes.append((*map(float, normal), float(-normal @ p)))
        if not planes:
            break
        x, y, z = F.col("x"), F.col("y"), F.col("z")
        counts = left.agg(*[F.sum((F.abs(a * x + b * y + c * z + d) < threshold).cast("long")).alias(f"p{k}") for k, (a, b, c, d) in enumerate(planes)]).first()
        best = int(np.argmax([v or 0 for v in counts]))
        inside = stored(plane_inliers(left, planes[best], threshold), "plane")
        hits = inside.agg(F.count(F.lit(1)).alias("n"), (F.max("distance") - F.min("distance")).alias("spread"), F.avg("distance").alias("mean")).first()
        if hits.n < max(1, min(stop_below, n)) and stop_below > 1:
            break
        out.append({"plane": planes[best], "inliers": hits.n, "mean_distance": hits["mean"], "thickness": hits.spread})
        left = stored(left.join(inside.select("id"), "id", "left_anti"), "rest")
    return out
