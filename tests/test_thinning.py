"""Poisson-disk samples against the passes written out, and their promises."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import thinning


def passes(points, distance, seed=0):
    """points: {id: xyz}. The same choice, one point after the other."""
    rank = lambda i: (int(md5(f"{i}:{seed}".encode()).hexdigest()[:13], 16), i)
    left, kept = dict(points), {}
    near = lambda a, b: ((a - b) ** 2).sum() < distance * distance
    while left:
        best = {}
        for i, p in left.items():
            cell = tuple(np.floor(p / (distance / 2)).astype(int))
            best[cell] = min(best.get(cell, i), i, key=rank)
        new = {}
        for i in sorted(best.values(), key=rank):
            if not any(near(left[i], q) for q in new.values()):
                new[i] = left[i]
        kept |= new
        left = {i: p for i, p in left.items() if not any(near(p, q) for q in new.values())}
    return kept


@pytest.mark.parametrize(("kind", "size"), [("even", 1000), ("even", 12), ("dense", 15)])
def test_equals_the_passes(spark, kind, size):
    rng = np.random.default_rng(2)
    xyz = rng.random((150, 3)) * 4
    if kind == "dense":  # a tight cluster and copies
        xyz = np.vstack([xyz, rng.random((80, 3)) * 0.3 + 1, np.full((30, 3), 2.5)])
    points = {5 * k + 1: p for k, p in enumerate(xyz)}
    df = spark.createDataFrame([(i, *map(float, p), "x") for i, p in points.items()] + [(10**6, None, 1.0, 1.0, "x")], "id long, x double, y double, z double, note string").repartition(3)
    got = {r.id: r for r in thinning.spaced(df, 0.8, 3, size).collect()}
    assert sorted(got) == sorted(passes(points, 0.8, 3)) and all(r.note == "x" for r in got.values())


def test_nothing_and_one(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert thinning.spaced(df.limit(0), 1.0).collect() == []
    assert thinning.spaced(df, 1.0).count() == 1


@pytest.mark.parametrize("shape", ["sphere", "cylinder"])
def test_shapes(spark, shape):
    n = 200
    p = np.array([(r.x, r.y, r.z) for r in thinning.on_shape(spark, shape, n).collect()])
    assert len(p) == n
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    d[np.arange(n), np.arange(n)] = np.inf
    least = thinning.SHARE * np.sqrt(thinning.area(shape) / n)
    assert d.min() >= least
    assert d.min(axis=1).max() < 3 * least  # no holes
    assert thinning.on_shape(spark, shape, 0).where(F.col("id") >= 0).count() == 0


def one_by_one(points, n, first=None):
    ids = np.array(sorted(points))
    xyz = np.array([points[i] for i in ids])
    at = int(np.flatnonzero(ids == first)[0]) if first is not None else 0
    out, d2, taken = [(0, int(ids[at]), None)], np.full(len(ids), np.inf), np.zeros(len(ids), bool)
    while len(out) < min(n, len(ids)):
        taken[at] = True
        d = xyz - xyz[at]
        d2 = np.minimum(d2, d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        at = int(np.where(taken, -1, d2).argmax())
        out.append((len(out), int(ids[at]), float(d2[at])))
    return out


@pytest.mark.parametrize(("kind", "n"), [("even", 120), ("ties", 60), ("copies", 200)])
def test_farthest_points_one_by_one(spark, monkeypatch, kind, n):
    """Small leaves and few candidates; a lattice, where many are as far; more than there are
    places."""
    from pointloom.operators import partition

    monkeypatch.setattr(partition, "LEAF", 12)
    monkeypatch.setattr(thinning, "SHOWN", 4)
    rng = np.random.default_rng(3)
    xyz = {"even": rng.random((300, 3)), "ties": np.array([(x, y, z) for x in range(5) for y in range(5) for z in range(4)], float), "copies": np.vstack([rng.random((60, 3)), np.full((50, 3), 0.5), np.full((30, 3), 0.25)])}[kind]
    order = rng.permutation(len(xyz)).tolist()
    points = {7 * i + 2: p for i, p in zip(order, xyz, strict=True)}
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in points.items()] + [(10**6, 1.0, None, 1.0)], "id long, x double, y double, z double").repartition(3)
    for first in (None, 7 * order[70] + 2):
        got = [(r.rank, r.id, r.d2) for r in thinning.farthest(df, n, first).orderBy("rank").collect()]
        assert got == one_by_one(points, n, first)


def test_farthest_of_nothing(spark):
    df = spark.createDataFrame([(4, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert thinning.farthest(df.limit(0), 5).collect() == thinning.farthest(df, 0).collect() == thinning.farthest(df, 3, 9).collect() == []
    assert [tuple(r) for r in thinning.farthest(df, 3).collect()] == [(0, 4, 0.0, 0.0, 0.0, None)]
