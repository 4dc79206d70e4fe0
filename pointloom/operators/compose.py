"""Cloud algebra and the class-aware pipelines."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spatial
from ..functions.lineage import stored
from . import geometry, graph, neighbors, partition, registration, sampling, smoothing

COLORS = ("r", "g", "b")


def of_classes(points: DataFrame, codes: list[int], keep: bool = True) -> DataFrame:
    """Rows of (or outside) the listed classes; a null class is in none."""
    inside: Column = F.coalesce(F.col("cls").isin([int(c) for c in codes]), F.lit(False))
    return points.where(inside if keep else ~inside)


def split_cloud(points: DataFrame, cloud: int) -> DataFrame:
    return points.where(F.col("cloud") == cloud)


def merge(*clouds: DataFrame) -> DataFrame:
    """All rows of all clouds (x, y, z and colours); colours are null unless every cloud has
    them; ids go, as they may repeat between clouds. No clouds is an error."""
    if not clouds:
        raise ValueError("there is nothing to merge")
    colored = all(set(COLORS) <= set(c.columns) for c in clouds)

    def shaped(c: DataFrame) -> DataFrame:
        return c.select("x", "y", "z", *[(F.col(k) if colored else F.lit(None)).cast("double").alias(k) for k in COLORS])

    out = shaped(clouds[0])
    for c in clouds[1:]:
        out = out.unionByName(shaped(c))
    return out


def project_rgb(records: DataFrame) -> DataFrame:
    """x, y, z and 16-bit red, green, blue scaled to [0, 1]."""
    return records.select("id", "x", "y", "z", *[(F.col(c) / 65535).alias(c[0]) for c in ("red", "green", "blue")])


def scan_ids(files: DataFrame, name: str = "name", pattern: str = r"\d{4}") -> DataFrame:
    """Adds ``scan_id``, the first match in the name; names without one are left out."""
    return files.withColumn("scan_id", F.regexp_extract(name, f"({pattern})", 1)).where("scan_id <> ''")


def voxel_size(a: DataFrame, b: DataFrame, share: float = 0.6, least: float = 0.04) -> DataFrame:
    """One row ``size``: the larger median nearest-point distance times ``share``, at least
    ``least``."""
    one = neighbors.nearest_other(a).agg(F.percentile("d", 0.5).alias("p"))
    two = neighbors.nearest_other(b).agg(F.percentile("d", 0.5).alias("q"))
    return one.crossJoin(two).select(F.greatest(F.greatest("p", "q") * share, F.lit(least)).alias("size"))


def simplify_cloud(points: DataFrame, radius: float, k: int, voxel: float) -> DataFrame:
    """Graph, scores, feature band, smoothing and thinning of one cloud."""
    adj = stored(graph.adjacency(points, radius, k), "graph")
    scores = stored(graph.high_pass_score(points, radius, k), "scores")
    return smoothing.simplify(points, adj, scores, voxel)


def simplify_class(a: DataFrame, b: DataFrame, codes: list[int], radius: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Both clouds' rows of the classes, simplified at their common voxel size."""
    a, b = of_classes(a, codes), of_classes(b, codes)
    size = voxel_size(a, b).first().size or 0.04
    return simplify_cloud(a, radius, k, size), simplify_cloud(b, radius, k, size)


def class_merge(points: DataFrame, first: list[int], second: list[int], radius: float, k: int, voxel: float, legacy_rest: bool = False) -> DataFrame:
    """(part, x, y, z): both class groups simplified, and the rest thinned. ``legacy_rest``
    thins the whole cloud as the rest."""
    rest = points if legacy_rest else of_classes(points, [*first, *second], keep=False)
    parts = [simplify_cloud(of_classes(points, c), radius, k, voxel).select(F.lit(n).alias("part"), "x", "y", "z") for n, c in (("first", first), ("second", second))]
    return parts[0].unionByName(parts[1]).unionByName(sampling.voxel_downsample(rest, voxel).select(F.lit("rest").alias("part"), "x", "y", "z"))


def compare(source: DataFrame, target: DataFrame, simple_source: DataFrame, simple_target: DataFrame, truth: registration.Matrix, distance: float = 0.1, iterations: int = 30) -> DataFrame:
    """One row per method: ICP on the clouds as they are and simplified, point and plane,
    with pose errors and the fit of the whole source."""
    held = {}
    for name, t in (("original", target), ("simplified", simple_target)):
        near = neighbors.knn(t.where(partition.FINITE), 30).where(F.col("d2") < (distance * 3) ** 2)
        held[name] = partition.Held(t.join(geometry.normals(near), "id", "left"), registration.NEEDS["plane"])

    def row(run: tuple[str, DataFrame, DataFrame, str]) -> tuple:
        name, s, t, method = run
        found, _, _ = registration.icp(s, t, distance, iterations=iterations, method=method, held=held[name])
        fit = registration.evaluate(registration.transform(source, found), target, held=held["original"]).first()
        return (name, method, *(float(v) for v in registration.pose_error(found, truth).values()), float(fit.fitness), float(fit.inlier_rmse))

    runs = [(*cloud, method) for cloud in (("original", source, target), ("simplified", simple_source, simple_target)) for method in ("point", "plane")]
    with ThreadPoolExecutor(len(runs)) as pool:  # a run's steps are short jobs, one after the other; they write nothing
        rows = list(pool.map(inheritable_thread_target(source.sparkSession)(row), runs))
    return source.sparkSession.createDataFrame(rows, "clouds string, method string, rotation_error_deg double, translation_error double, rotation_error_rad double, translation_difference double, fitness double, inlier_rmse double")


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table`` for their key; a key that the table lacks (or a
    null key) is an error when the row is read."""
    found = rows.join(table.withColumn("found_", F.lit(True)), key, "left")
    miss = F.when(F.col("found_").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col(key))
    return found.withColumn(key, miss).drop("found_")


def paint(points: DataFrame, color: tuple[float, float, float]) -> DataFrame:
    """All points in one colour."""
    return points.withColumns({c: F.lit(float(v)) for c, v in zip(COLORS, color, strict=True)})


def map_batches(points: DataFrame, f: Callable, schema: str, batch: str = "batch") -> DataFrame:
    """``f`` (pandas frame to pandas frame) on each batch that :func:`sampling.batch_split` has
    made; a task holds one batch, so their size bounds its memory."""
    return points.groupBy(batch).applyInPandas(f, schema)


def _batched(points: DataFrame, batch_size: int | None) -> tuple[DataFrame, tuple[str, ...]]:
    if not batch_size or points.count() <= batch_size:
        return points, ()
    return stored(sampling.batch_split(points, batch_size), "batches"), ("batch",)


def score_cloud(points: DataFrame, radius: float, k: int, batch_size: int | None = None, cut: float = 0.6) -> DataFrame:
    """``points`` with their score, its norm and the clamped green ``g``. With more points than
    ``batch_size``, neighbours are sought within batches of that many points by id."""
    held, by = _batched(points, batch_size)
    scores = sampling.normalize_clamp(graph.high_pass_score(held, radius, k, by), cut)
    return points.join(scores.select("id", "score", "norm", "g"), "id")


def sample_cloud(points: DataFrame, radius: float, k: int, n: int = 0, method: str = "topk", voxel: float = 0.1, batch_size: int | None = None, cut: float = 0.6, seed: int = 0) -> DataFrame:
    """The whole sampling run: batches above ``batch_size``, score, paint, then sample n points
    (topk, weighted, random) or smooth and thin (smooth)."""
    if method == "smooth":
        held, by = _batched(points, batch_size)
        adj = stored(graph.adjacency(held, radius, k, by=by), "graph")
        return smoothing.simplify(points, adj, stored(graph.high_pass_score(held, radius, k, by), "scores"), voxel)
    return sampling.sample_points(score_cloud(points, radius, k, batch_size, cut), n, method, seed=seed)


def coarse_run(source: DataFrame, target: DataFrame, pose: registration.Matrix, truth: registration.Matrix, feature: str = "feature", k: int = 20, ratios: tuple[float, float] = (5.0, 11.0), subsample: int = -1) -> tuple[registration.Matrix, dict[str, float]]:
    """Coarse registration as a whole: both clouds without outliers, the source under a random
    ``pose``, alignment by features, and the error of the combined motion against ``truth``.
    Returns the motion found for the posed source, and the errors."""
    s = stored(geometry.outliers(source, k, ratios[0]), "source")
    t = stored(geometry.outliers(target, k, ratios[1]), "target")
    found = registration.coarse_registration(stored(registration.transform(s, pose), "posed"), t, feature, subsample)
    return found, registration.pose_error(registration.product(found, pose), truth)


def fine_registration(source: DataFrame, target: DataFrame, simple_source: DataFrame, simple_target: DataFrame, start: registration.Matrix, truth: registration.Matrix, voxel: float = 0.05, distance: float = 0.1, radius: float = 0.5, k: int = 60, iterations: int = 100) -> DataFrame:
    """One row per run: plane ICP on the simplified clouds and on the whole ones, and coloured
    ICP on the whole ones after the source's colours are matched to the target's. All are
    thinned at ``voxel``; errors are those of ``start`` times the motion found.

    The clouds have r, g, b; intensity is their mean."""

    def thin(points: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        cells = sampling.voxel_downsample(points, voxel, columns)
        return stored(cells.select(F.xxhash64("cx", "cy", "cz").alias("id"), *columns), "thin")

    def normed(points: DataFrame) -> DataFrame:
        return points.join(geometry.normals(graph.edges(points, radius, k)), "id")

    matched = source
    for c in COLORS:
        matched = sampling.hist_match(matched, target.select(F.col(c)), c).drop(c).withColumnRenamed("out", c)
    shade = ((F.col("r") + F.col("g") + F.col("b")) / 3).alias("i")
    plain, colored = spatial.XYZ, (*spatial.XYZ, *COLORS)
    rows = []
    for name, s, t, method in (("simplified", simple_source, simple_target, "plane"), ("whole", source, target, "plane"), ("colored", matched, target, "color")):
        columns = colored if method == "color" else plain
        a, b = thin(s, columns), thin(t, columns)
        b = stored(normed(b), "target")
        if method == "color":
            a, b = a.select("*", shade), b.select("*", shade)
            b = stored(registration.color_gradients(b, stored(graph.edges(b, radius, k), "edges")), "target")
        found, fitness, rmse = registration.icp(a, b, distance, iterations=iterations, method=method)
        errors = registration.pose_error(registration.product(start, found), truth)
        rows.append((name, errors["rotation_error_rad"], errors["translation_difference"], float(fitness), float(rmse)))
    return source.sparkSession.createDataFrame(rows, "run string, rotation_error_rad double, translation_difference double, fitness double, inlier_rmse double")
