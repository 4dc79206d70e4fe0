"""Selection, sampling, voxel grids, normalisation and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spatial
from ..functions.lineage import stored


def running(df: DataFrame, order: list, measure: Column | None = None, name: str = "rank_") -> DataFrame:
    """``df`` with the running sum of ``measure`` (default: 1 a row) in the given order.

    A range partitioning, a window inside each range, and the ranges' offsets (one short row
    each): never one global window, and no limit on the number of rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("m_", F.lit(1).cast("long") if measure is None else measure)
    ranged = stored(ranged.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part_").agg(F.sum("m_").alias("t_"))
    before = F.sum("t_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part_", F.coalesce(before, F.lit(0)).alias("before_"))  # a row per range
    inside = F.sum("m_").over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("r_", inside).join(F.broadcast(offsets), "part_").withColumn(name, F.col("before_") + F.col("r_")).drop("part_", "r_", "before_", "m_")


def normalize_clamp(scores: DataFrame, cut: float = 0.6, col: str = "score") -> DataFrame:
    """Adds ``norm`` (min-max) and ``g`` (norm, 1 above ``cut``). If all scores are equal,
    norm is 0; a null score stays null."""
    span = scores.agg(F.min(col).alias("lo_"), F.max(col).alias("hi_"))
    norm = F.when(F.col("hi_") > F.col("lo_"), (F.col(col) - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))).when(F.col(col).isNotNull(), 0.0)
    out = scores.crossJoin(F.broadcast(span)).withColumn("norm", norm)
    return out.withColumn("g", F.when(F.col("norm") > cut, 1.0).otherwise(F.col("norm"))).drop("lo_", "hi_")


def winsorize(scores: DataFrame, times: float = 6.0, col: str = "score") -> DataFrame:
    """Adds ``norm``: min-max of the scores capped at ``times`` their mean."""
    capped = scores.crossJoin(F.broadcast(scores.agg((F.avg(col) * times).alias("cap_")))).withColumn("w_", F.least(col, "cap_"))
    return normalize_clamp(capped, 2.0, "w_").drop("cap_", "w_", "g")


#: Rows up to which the first of an order are kept in each task and merged in one; more are
#: found by running counts over ranges.
MERGED = 10_000


def first_of(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order that leaves no ties."""
    if n <= MERGED:
        return rows.orderBy(*order).limit(max(0, n))
    return running(rows, order, name="first_").where(F.col("first_") <= n).drop("first_")


def topk(scores: DataFrame, n: int, by: str = "g", rule: str = "not_one") -> DataFrame:
    """The n highest below the clamp. not_one drops values equal to 1, below_one values of 1
    or more; ties go to the lower id."""
    keep = {"not_one": F.col(by) != 1, "below_one": F.col(by) < 1}[rule]
    return first_of(scores.where(keep), [F.desc(by), F.asc("id")], n)


def topk_extremes(scores: DataFrame, n: int, by: str = "score") -> DataFrame:
    """The n highest and the 2n lowest (3n rows, repeated where they overlap)."""
    return first_of(scores, [F.desc(by), F.asc("id")], n).unionAll(first_of(scores, [F.asc(by), F.asc("id")], 2 * n))


def weighted_sample(scores: DataFrame, n: int, by: str = "score", seed: int = 0) -> DataFrame:
    """n rows without replacement with probability by weight (exponential keys); rows of
    weight 0, null or 1 (clamped) are never drawn. The draw depends on id and seed only: 52
    bits of an MD5 digest, which any engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1).cast("double") / F.lit(2.0**52 + 2)
    keyed = scores.where((F.col(by) > 0) & (F.col(by) != 1)).withColumn("key_", -F.log(u) / F.col(by))
    return first_of(keyed, [F.asc("key_"), F.asc("id")], n).drop("key_")


def sample_points(scores: DataFrame, n: int, method: str = "topk", by: str = "g", seed: int = 0) -> DataFrame:
    if method == "topk":
        return topk(scores, n, by)
    if method in ("random", "weighted"):
        return weighted_sample(scores, n, by, seed)
    raise ValueError(f"unknown method {method!r}")


def feature_band(scores: DataFrame, skip: float = 0.001, take: float = 0.1, by: str = "score") -> DataFrame:
    """Adds ``feature``: whether the row's rank by descending score (ties: the lower id) lies
    past the first int(skip n) and within the next int(take n). Null scores come last.

    Ranks are running counts over ranges of scores, so ranking isn't a single task."""
    n = scores.count()
    first, last = int(skip * n), int(skip * n) + int(take * n)
    ranked = running(scores, [F.desc(by), F.asc("id")])
    return ranked.withColumn("feature", (F.col("rank_") > first) & (F.col("rank_") <= last) & F.col(by).isNotNull()).drop("rank_")


def split_low_high(filtered_low: DataFrame, scores: DataFrame, share: float = 0.3) -> DataFrame:
    """(id, part, x, y, z): low-pass points of the lowest share of the scores above the raw
    points of the highest share (ties: the lower id). ``filtered_low`` has fx, fy, fz beside
    x, y, z."""
    n = int(share * scores.count())
    low = running(scores.select("id", "score"), [F.asc("score"), F.asc("id")]).where(F.col("rank_") <= n)
    high = running(scores.select("id", "score"), [F.desc("score"), F.asc("id")]).where(F.col("rank_") <= n)
    smooth = filtered_low.join(low, "id", "left_semi").select("id", F.lit("low").alias("part"), F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fz").alias("z"))
    raw = filtered_low.join(high, "id", "left_semi").select("id", F.lit("high").alias("part"), "x", "y", "z")
    return smooth.unionByName(raw)


def _bounds(points: DataFrame) -> tuple[list[float], list[float], int]:
    r = points.agg(F.count(F.lit(1)).alias("n"), *[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    return [r[1] or 0.0, r[3] or 0.0, r[5] or 0.0], [r[2] or 0.0, r[4] or 0.0, r[6] or 0.0], r[0]


def voxel_downsample(points: DataFrame, size: float, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(cx, cy, cz, n, means): one mean row per occupied voxel; the grid starts half a voxel
    below the minimum. Means are partial aggregates, so dense voxels don't skew."""
    low, _, _ = _bounds(points)
    cells = spatial.cell(size, tuple(v - size / 2 for v in low))
    return points.select("*", *cells).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def voxel_pick(points: DataFrame, rate: float, seed: int | None = None) -> DataFrame:
    """One point per voxel, with voxels so large that about ``rate`` of the points stay: the
    lowest id, or with a seed the lowest hash of id and seed."""
    if not 0 < rate <= 1:
        raise ValueError("rate lies between 0 and 1")
    low, high, n = _bounds(points)
    target = max(1, int(n * rate))
    volume = 1.0
    for a, b in zip(low, high, strict=True):
        volume *= b - a
    size = (volume / target) ** (1 / 3) or 1.0
    order = F.col("id") if seed is None else F.xxhash64("id", F.lit(seed))
    best = F.min_by(F.struct("id", "x", "y", "z"), order).alias("p")
    return points.select("id", "x", "y", "z", *spatial.cell(size, tuple(low))).groupBy("cx", "cy", "cz").agg(best).select("p.*")


def voxel_quantize(points: DataFrame, size: float) -> DataFrame:
    """(cx, cy, cz, id, x, y, z): floor(x/size) with the lowest id as representative."""
    kept = F.min_by(F.struct("id", "x", "y", "z"), F.col("id")).alias("p")
    return points.select("id", "x", "y", "z", *spatial.cell(size)).groupBy("cx", "cy", "cz").agg(kept).select("cx", "cy", "cz", "p.*")


def color_select(points: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Points with green below the threshold."""
    return points.where(F.col("g") < threshold)


def overlap_select(points: DataFrame, distances: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Points nearer than ``threshold`` to the other cloud; ``distances`` has (id, d)."""
    return points.join(distances.where(F.col("d") < threshold), "id", "left_semi")


def sort_z(points: DataFrame) -> DataFrame:
    return points.orderBy("z", "id")


def batch_split(points: DataFrame, batch_size: int, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Adds ``batch``: slices of ``batch_size`` rows in the order of ``by``."""
    ranked = running(points, [F.asc(c) for c in by])
    return ranked.withColumn("batch", F.floor((F.col("rank_") - 1) / batch_size)).drop("rank_")


def hist_stretch(values: DataFrame, threshold: int, col: str = "v", bins: int = 256) -> DataFrame:
    """Adds ``out``: values in bins of fewer than ``threshold`` become 1, the rest is
    stretched to [0, 1]. Bins lie on [0, 1]; 1 falls in the last bin."""
    b = F.least(F.floor(F.col(col) * bins), F.lit(bins - 1))
    marked = values.withColumn("bin_", b)
    rare = marked.groupBy("bin_").agg(F.count(F.lit(1)).alias("n_"))
    # at most ``bins`` rows, and one for nulls
    held = marked.join(F.broadcast(rare), marked["bin_"].eqNullSafe(rare["bin_"])).drop(rare["bin_"])
    inside = F.col(col).between(0, 1)
    rest = F.when((F.col("n_") >= threshold) | ~inside | (F.col(col) == 1), F.col(col)).otherwise(1.0)
    held = held.withColumn("u_", rest)
    span = held.where("u_ <> 1").agg(F.min("u_").alias("lo_"), F.max("u_").alias("hi_"))
    out = F.when(F.col("u_") == 1, 1.0).when(F.col("hi_") > F.col("lo_"), (F.col("u_") - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))).otherwise(F.col("u_"))
    return held.crossJoin(F.broadcast(span)).withColumn("out", out).drop("bin_", "n_", "u_", "lo_", "hi_")


def hist_match(source: DataFrame, target: DataFrame, col: str = "v") -> DataFrame:
    """``source`` with ``out``: values mapped so that their distribution follows the target's,
    by linear interpolation between the target's quantiles.

    Exact: both cumulative distributions over all distinct values are merged by quantile in
    ranges; each range is a window of its own, and the last and first target values of the
    ranges around it (one short row a range) carry over. Null values stay null."""

    def cdf(df: DataFrame, kind: int) -> DataFrame:
        counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("u")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").alias("all_"))
        return running(counts, [F.asc("u")], F.col("n"), "run").crossJoin(F.broadcast(total)).select((F.col("run") / F.col("all_")).alias("q"), F.lit(kind).alias("kind"), "u")

    spark = source.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = cdf(target, 0).unionByName(cdf(source, 1))
    ranged = stored(merged.repartitionByRange(n, "q", "kind").withColumn("part_", F.spark_partition_id()), "merged")
    knot = F.when(F.col("kind") == 0, F.struct("q", "u"))
    ends = ranged.withColumn("knot", knot).groupBy("part_").agg(F.min("knot").alias("first_"), F.max("knot").alias("last_"))
    back = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("part_").rowsBetween(1, Window.unboundedFollowing)
    around = ends.select("part_", F.last("last_", ignorenulls=True).over(back).alias("before_"), F.first("first_", ignorenulls=True).over(ahead).alias("after_"))
    inside = Window.partitionBy("part_").orderBy("q", "kind")
    behind = Window.partitionBy("part_").orderBy(F.desc("q"), F.desc("kind"))  # both frames run along
    held = ranged.withColumn("knot", knot).withColumns({"lo": F.last("knot", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "hi": F.last("knot", ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, -1))})
    met = held.where("kind = 1").join(F.broadcast(around), "part_").select(F.col("u").alias("s_"), "q", F.coalesce("lo", "before_").alias("lo"), F.coalesce("hi", "after_").alias("hi"))
    line = F.col("lo.u") + (F.col("hi.u") - F.col("lo.u")) * (F.col("q") - F.col("lo.q")) / (F.col("hi.q") - F.col("lo.q"))
    mapped = met.select("s_", F.when(F.col("lo").isNull(), F.col("hi.u")).when(F.col("hi").isNull(), F.col("lo.u")).otherwise(line).alias("out"))
    return source.join(mapped, source[col].cast("double") == mapped["s_"], "left").drop("s_")
