"""Nearest neighbours over a balanced partition against brute force."""

import numpy as np
import pytest

from pointloom.operators import neighbors, partition


def cloud(spark, xyz, first=0):
    return spark.createDataFrame([(first + k, *map(float, p)) for k, p in enumerate(xyz)], "id long, x double, y double, z double").repartition(3)


def brute(q, t, k):
    out = set()
    for i, p in enumerate(q):
        d2 = ((p[0] - t[:, 0]) * (p[0] - t[:, 0]) + (p[1] - t[:, 1]) * (p[1] - t[:, 1])) + (p[2] - t[:, 2]) * (p[2] - t[:, 2])
        out |= {(i, j, n + 1, d) for n, (d, j) in enumerate(sorted(zip(d2.tolist(), range(len(t)), strict=True))[:k])}
    return out


def found(df):
    rows = df.collect()
    gaps = [[r[f"s{c}"] - r[f"t{c}"] for c in "xyz"] for r in rows]
    assert [r.d2 for r in rows] == [x * x + y * y + z * z for x, y, z in gaps]
    return {(r.src, r.dst, r.rn, r.d2) for r in rows}


def clouds():
    rng = np.random.default_rng(7)
    base = rng.random((300, 3))
    lattice = np.array([(x, y, z) for x in range(6) for y in range(6) for z in range(6)], float)
    away = rng.normal(size=(40, 3))
    away *= (rng.uniform(10, 2000, 40) / np.linalg.norm(away, axis=1))[:, None]
    return {"even": base, "far": np.vstack([base, away, [[1e6, -1e6, 0]]]), "ties": lattice, "cluster": np.vstack([base, rng.random((200, 3)) * 1e-4 + 0.5]), "coinciding": np.vstack([base, np.full((200, 3), 0.25), np.full((40, 3), 0.75)]), "line": np.stack([np.arange(200.0), np.zeros(200), np.zeros(200)], axis=1), "one": base[:1], "place": np.full((100, 3), 3.0)}


@pytest.mark.parametrize("kind", list(clouds()))
def test_knn_of_a_cloud(spark, monkeypatch, kind):
    """Small leaves, several tasks a leaf, crowded leaves."""
    for name, v in (("LEAF", 8), ("QUERIES", 10), ("CROWD", 3), ("AT_ONCE", 100)):
        monkeypatch.setattr(partition, name, v)
    xyz = clouds()[kind]
    assert found(neighbors.knn(cloud(spark, xyz), 3)) == brute(xyz, xyz, 3)


@pytest.mark.parametrize("k", [1, 7, 400])
def test_knn_of_other_points(spark, monkeypatch, k):
    """Queries within, beside and far from the cloud; k beyond a leaf and beyond the cloud."""
    monkeypatch.setattr(partition, "LEAF", 4)
    rng = np.random.default_rng(3)
    t = rng.random((120, 3))
    q = np.vstack([t[:20], rng.random((20, 3)) + 0.9, rng.random((20, 3)) + 500])
    assert found(neighbors.knn(cloud(spark, q), k, cloud(spark, t))) == brute(q, t, k)


def test_knn_of_nothing(spark):
    none, one = cloud(spark, np.zeros((1, 3))).limit(0), cloud(spark, [[1, 2, 3]])
    assert neighbors.knn(none, 2).collect() == neighbors.knn(one, 2, none).collect() == neighbors.knn(none, 2, one).collect() == []
    assert neighbors.nearest_other(one).collect() == []


def test_sampled_cuts_and_few_leaves(spark, monkeypatch):
    for name, v in (("SAMPLE", 40), ("MOST_LEAVES", 5), ("LEAF", 8)):
        monkeypatch.setattr(partition, name, v)
    xyz = np.random.default_rng(1).normal(size=(500, 3)) ** 3
    assert found(neighbors.knn(cloud(spark, xyz), 4)) == brute(xyz, xyz, 4)


def test_leaves_are_balanced():
    """Whatever the density, cuts at medians leave like shares."""
    rng = np.random.default_rng(2)
    xyz = np.vstack([rng.random((5000, 3)), rng.random((5000, 3)) * 1e-6, rng.normal(size=(200, 3)) * 1e4])
    tree = partition.grown(xyz, 64)
    count = np.bincount(tree.leaf_of(xyz))
    assert len(count) == 64 and count.max() <= 2 * count.min() + 2


def test_few_leaves_are_visited():
    """Far queries touch the leaves on their side of the cloud, near ones their surroundings."""
    rng = np.random.default_rng(4)
    xyz = rng.random((20_000, 3))
    tree = partition.grown(xyz, 512)
    leaf = tree.leaf_of(xyz)
    for n in np.flatnonzero(tree.axis < 0):
        inside = xyz[leaf == tree.leaf[n]]
        tree.count[n], tree.low[n], tree.high[n] = len(inside), inside.min(axis=0), inside.max(axis=0)
    for n in range(len(tree.axis) - 1, -1, -1):
        if tree.axis[n] >= 0:
            kids = [tree.left[n], tree.right[n]]
            tree.count[n], tree.low[n], tree.high[n] = tree.count[kids].sum(), tree.low[kids].min(axis=0), tree.high[kids].max(axis=0)
    q, _ = tree.touched(xyz[:1000], np.full(1000, 0.02**2))
    assert len(q) < 4 * 1000
    far = np.array([[500.0, 0.5, 0.5]])
    assert len(tree.touched(far, tree.bound(far, 1))[0]) < 200


def test_first_rows_of_ranges(spark, monkeypatch):
    """The same rows by a merge and by running counts."""
    from pyspark.sql import functions as F

    from pointloom.operators import sampling

    rows = spark.range(500).repartition(4).select("id", (F.col("id") % 37 / 36).alias("g"))
    small = [sorted(map(tuple, f.collect())) for f in (sampling.topk(rows, 60), sampling.topk_extremes(rows, 40, "g"), sampling.weighted_sample(rows, 50, "g", 3))]
    monkeypatch.setattr(sampling, "MERGED", 0)
    assert small == [sorted(map(tuple, f.collect())) for f in (sampling.topk(rows, 60), sampling.topk_extremes(rows, 40, "g"), sampling.weighted_sample(rows, 50, "g", 3))]
