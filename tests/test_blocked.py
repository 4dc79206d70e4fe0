"""Iterations over blocked graphs against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import blocked, graph


def cloud(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(7 * k + 3, *rng.normal(size=3).tolist()) for k in range(n)]
    rows[1] = (rows[1][0], *rows[0][1:])  # two points at one place
    return spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3), np.array(rows)


def directed(spark, n, k, seed=1):
    """Random directed edges, one point being everybody's neighbour, one without edges."""
    rng = np.random.default_rng(seed)
    rows = {(7 * a + 3, 7 * int(b) + 3): float(rng.uniform(0.1, 1)) for a in range(n - 1) for b in [*rng.integers(0, n - 1, k), 0]}
    w = np.zeros((n, n))
    for (a, b), v in rows.items():
        w[(a - 3) // 7, (b - 3) // 7] = v
    return spark.createDataFrame([(*e, v) for e, v in rows.items()] + [(3, 10**6, 1.0)], "src long, dst long, w double"), w


@pytest.mark.parametrize("size", [1000, 7])
def test_products(spark, size):
    """W x by gathering and W'x by scattering, several steps in one job."""
    p, rows = cloud(spark, 60)
    e, w = directed(spark, 60, 4)
    g = blocked.Graph(p, e, ("x", "y"), size)
    assert g.whole == (size == 1000) and g.count == 60
    first = g.start(lambda b: blocked.Outbox(x := np.stack([b.data["x"], b.data["y"]], axis=1), x))

    def times(b, box):
        y = b.times(box.own, box.border)
        mine, theirs = b.transposed(y)
        return blocked.Outbox(mine, scatter=theirs)

    def collect(b, box):
        return blocked.Outbox(v := box.own + box.given, v)

    twice = first
    for _ in range(2):
        twice = g.step(g.step(twice, times, 2, 2), collect, 2, 0, 2)
    got = {r.id: (r.a, r.b) for r in g.state(twice, ["a", "b"], 2).collect()}
    want = w.T @ w @ w.T @ w @ rows[:, 1:3]
    assert np.allclose([got[int(i)] for i in rows[:, 0]], want)
    assert np.allclose(blocked.summed(twice, 2, lambda s: s.T @ s).reshape(2, 2), want.T @ want)
    plan = g.step(first, collect, 2, 0, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # only the state moves
    g.close()


@pytest.mark.parametrize(("n", "count", "size"), [(60, 4, 20), (60, 6, 1000), (9, 20, 4), (0, 3, 4)])
def test_fourier_equals_dense(spark, n, count, size):
    p, rows = cloud(spark, n) if n else (spark.createDataFrame([], "id long, x double, y double, z double"), None)
    e, w = directed(spark, n, 4) if n else (spark.createDataFrame([], "src long, dst long, w double"), None)
    got = graph.fourier(p, e, count, size=size).orderBy("n").collect()
    if not n:
        assert got == []
        return
    w = w - np.diag(np.diag(w))
    lap = np.diag(w.sum(axis=1)) - w
    lap[0, 0] += 1  # an edge to a missing point counts for the degree only
    values, vectors = np.linalg.eigh((lap + lap.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[: min(count, n)]
    assert np.allclose([r.eigenvalue for r in got], values[order], atol=1e-9)
    assert np.allclose(np.abs([(r.x, r.y, r.z) for r in got]), np.abs(vectors[:, order].T @ rows[:, 1:]), atol=1e-5)
    assert max(r.residual for r in got) <= 1e-6 * abs(values[order[0]])


@pytest.mark.parametrize("hub", [256, 3])
def test_fourier_keeps_the_files_of_one_step(spark, monkeypatch, hub):
    """The disk in use must not grow with the products: rows gathered (no hubs) or scattered."""
    from pathlib import Path

    from pointloom.functions import lineage

    top, seen = Path(lineage.shared_dir(spark)), []
    before = {f.name for f in top.iterdir()}

    def counted(rows, *more, of=blocked.summed):
        seen.append(sorted(f.name.split("-")[0].split("_")[0] for f in top.iterdir() if f.name not in before))
        return of(rows, *more)

    monkeypatch.setattr(graph, "summed", counted)
    monkeypatch.setattr(graph, "HUB", hub, raising=False)
    monkeypatch.setattr(graph, "MOVED", 1, raising=False)  # a job for each product
    p, rows = cloud(spark, 30)
    e, w = directed(spark, 30, 4)
    w = w - np.diag(np.diag(w))
    got = graph.fourier(p, e.where("dst < 1000"), 3, size=15).orderBy("n").collect()
    lap = np.diag(w.sum(axis=1)) - w
    values = np.linalg.eigvalsh((lap + lap.T) / 2)
    assert np.allclose([r.eigenvalue for r in got], values[np.argsort(-np.abs(values))][:3], atol=1e-9)
    assert len(seen) > 1 and set(map(tuple, seen)) == {("basis", "blocks")}
    assert {f.name for f in top.iterdir()} == before


def test_stored_steps_leave_no_shuffle_files(spark):
    import os
    import time

    from pointloom.functions import lineage

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {f for d in env.blockManager().diskBlockManager().localDirsString() for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    before = files()
    got = lineage.stored(spark.range(100).repartition(3, "id"), "shuffled")
    for _ in range(100):  # they are deleted in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and got.count() == 100


def test_curve_keeps_neighbours_together(spark):
    p = spark.range(4096).select("id", *[(F.shiftright("id", 4 * k) % 16).cast("double").alias(c) for k, c in enumerate("xyz")])
    at = p.withColumn("place", blocked.curve(p)).orderBy("place").limit(64).agg(*[F.max(c) for c in "xyz"]).first()
    assert tuple(at) == (3.0, 3.0, 3.0)


def solved(p, e, w, rows, kind, size, feature=None):
    from pointloom.operators import smoothing

    w = w - np.diag(np.diag(w))
    lap, mark = np.diag(w.sum(axis=1)) - w, np.isin(rows[:, 0], feature or [])
    mask = None if feature is None else p.select("id", F.col("id").isin(feature).alias("feature"))
    if kind == "smooth":
        m = 0.9 * (0.8 + mark)
        return smoothing.smooth(p, e, mask, size=size), np.linalg.solve(0.1 * lap + np.diag(m), m[:, None] * rows[:, 1:])
    if kind == "squared":
        m = 0.95 * (1 + mark)
        return smoothing.smooth_squared(p, e, mask, tolerance=1e-10, size=size), np.linalg.solve(0.05 * lap.T @ lap + np.diag(m), m[:, None] * rows[:, 1:])
    a = 6.0
    return smoothing.smooth_mean(p, e, a, 1e-10, size=size), np.linalg.solve((lap + lap.T) / 2 + a * np.eye(len(rows)), a * rows[:, 1:])


@pytest.mark.parametrize("kind", ["smooth", "squared", "mean"])
@pytest.mark.parametrize("size", [1000, 9])
def test_smoothers_equal_dense(spark, kind, size):
    """In one block and in several, with a point that everybody refers to."""
    p, rows = cloud(spark, 40)
    e, w = directed(spark, 40, 3)
    got, want = solved(p, e.where("dst < 1000"), w, rows, kind, size, [3, 17, 24] if kind != "mean" else None)
    got = {r.id: (r.x, r.y, r.z) for r in got.collect()}
    assert np.allclose([got[int(i)] for i in rows[:, 0]], want, atol=1e-8)


@pytest.mark.parametrize("size", [1000, 9])
def test_indefinite_systems_are_errors(spark, size):
    from pointloom.operators import smoothing

    p, _ = cloud(spark, 40)
    e, _ = directed(spark, 40, 3)
    with pytest.raises(Exception, match="definite"):
        smoothing.smooth_mean(p, e.where("dst < 1000"), 0.01, size=size).collect()


def test_smoothers_of_nothing(spark):
    from pointloom.operators import smoothing

    p, e = spark.createDataFrame([], "id long, x double, y double, z double"), spark.createDataFrame([], "src long, dst long, w double")
    for f in (lambda: smoothing.smooth(p, e, None), lambda: smoothing.smooth_squared(p, e), lambda: smoothing.smooth_mean(p, e)):
        assert f().collect() == []
    one = spark.createDataFrame([(1, 2.0, None, 3.0)], "id long, x double, y double, z double")
    for f in (lambda: smoothing.smooth(one, e, None), lambda: smoothing.smooth_squared(one, e), lambda: smoothing.smooth_mean(one, e)):
        (r,) = f().collect()
        assert (round(r.x, 9), r.y, round(r.z, 9)) == (2.0, None, 3.0)


@pytest.mark.parametrize("size", [1000, 15])
def test_largest_eigenvalue_in_blocks(spark, size):
    p, _ = cloud(spark, 40)
    e, w = directed(spark, 40, 3)
    got = graph.largest_eigenvalue(p, e.where("dst < 1000"), 1e-6, size=size)
    assert abs(got - np.abs(np.linalg.eigvals(w)).max()) < 1e-4
    assert graph.largest_eigenvalue(p, e.limit(0), size=size) == graph.largest_eigenvalue(p.limit(0), e.limit(0)) == 0
