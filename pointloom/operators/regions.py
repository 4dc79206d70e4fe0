"""Connected components of a graph, and smooth regions of a cloud."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label): every end of an edge (src, dst) with the least id of its component.

    Rounds contract the graph: every node hooks onto the neighbour (or itself) that comes first
    in the round's own random order, paths are cut short until all point at their roots, and
    edges go on between roots. Orders that differ each round leave about a third of the nodes
    or fewer, whatever the ids are. Null ends are left out."""
    pairs = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    labels = stored(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    pairs, turn = stored(pairs.where("src <> dst").distinct(), "pairs"), 0
    while not pairs.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("p"))  # noqa: B023, E731
        both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        first = both.groupBy("src").agg(F.min(rank("dst")).alias("near"))
        parent = stored(first.select(F.col("src").alias("node"), F.least(F.col("near"), rank("src"))["p"].alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = stored(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "parents")
            parent = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        to = lambda c, name: parent.select(F.col("node").alias(c), F.col("root").alias(name))  # noqa: B023, E731
        labels = stored(labels.join(to("label", "root"), "label", "left").select("id", F.coalesce("root", "label").alias("label")), "labels")
        pairs = stored(pairs.join(to("src", "a"), "src").join(to("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "pairs")
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    return labels.join(least, "label").select("id", F.col("least").alias("label"))


def grow(points: DataFrame, edges: DataFrame, angle: float = 0.1, flat: float = 0.05, least: int = 1) -> DataFrame:
    """(id, region, size): smooth regions of a cloud with normals nx, ny, nz and ``curvature``.

    Points of a curvature below ``flat`` that are neighbours and whose normals differ by less
    than ``angle`` (in radians, either way round) share a region: however it is grown, from
    whatever seeds, this is what it fills. A point beyond that curvature joins the region of
    the flat neighbour whose normal is nearest to its own (ties: the lower id), if that differs
    by less than ``angle``, and doesn't pass it on. Regions are named by their least flat
    point; ``region`` is null in regions of fewer than ``least`` points and elsewhere.

    ``edges`` (src, dst) count in both directions; null normals and curvatures join nothing."""
    side = lambda p: points.select(F.col("id").alias(p), *[F.col(f"n{c}").alias(f"{p}{c}") for c in "xyz"], F.col("curvature").alias(f"{p}k"))
    known = edges.where("src <> dst").select("src", "dst")
    both = known.unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    along = F.abs(sum((F.col(f"src{c}") * F.col(f"dst{c}") for c in "xyz"), F.lit(0.0)))
    near = stored(both.join(side("src"), "src").join(side("dst"), "dst").withColumn("along", along).where((F.col("along") > math.cos(angle)) & (F.col("dstk") < flat)).select("src", "dst", "along", (F.col("srck") < flat).alias("inner")), "near")
    core = points.where(F.col("curvature") < flat).select("id")
    found = components(near.where("inner").select("src", "dst").unionByName(core.select(F.col("id").alias("src"), F.col("id").alias("dst"))))
    found = stored(core.join(found, "id").select("id", F.col("label").alias("region")), "cores")
    rim = near.where(~F.coalesce("inner", F.lit(False))).groupBy(F.col("src").alias("id")).agg(F.min(F.struct(-F.col("along"), F.col("dst").alias("to"))).alias("m")).select("id", F.col("m.to").alias("to"))
    rim = rim.join(found.select(F.col("id").alias("to"), "region"), "to").select("id", "region")
    every = stored(found.unionByName(rim), "regions")
    sizes = every.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return points.select("id").join(every.join(sizes, "region"), "id", "left").select("id", "region", "size")
