"""Registration of noisy clouds that overlap in part, and what a step moves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.lineage import stored
from pointloom.operators import compose, geometry, neighbors, partition, registration


def surfaces(n, seed=0):
    """Points of a bent sheet and a wall, with their colour."""
    rng = np.random.default_rng(seed)
    u, v = rng.random(n) * 2, rng.random(n) * 2
    xyz = np.stack([u, v, 0.3 * np.sin(3 * u) * np.cos(2 * v)], axis=1)
    wall = np.stack([np.zeros(n // 2), rng.random(n // 2) * 2, rng.random(n // 2)], axis=1)
    return np.vstack([xyz, wall])


def frame(spark, xyz):
    return spark.createDataFrame([(k, *map(float, p), float(np.sin(4 * p[0]) + np.cos(5 * p[1]))) for k, p in enumerate(xyz)], "id long, x double, y double, z double, i double").repartition(3)


@pytest.mark.parametrize("method", ["point", "plane", "color"])
def test_noise_and_partial_overlap(spark, method):
    """A part of each cloud is missing in the other, and both are noisy; the methods that know
    the surface get different samples of it."""
    rng = np.random.default_rng(4)
    motion = registration.axis_angle([0.2, 0.1, 1.0], 0.03, [0.03, -0.02, 0.02])
    a, b = surfaces(900, 1), surfaces(900, 1 if method == "point" else 2)
    a, b = a[a[:, 1] < 1.7], b[b[:, 1] > 0.3]
    m = np.asarray(motion)
    target = frame(spark, b + rng.normal(size=b.shape) * 0.002)
    if method != "point":
        edges = neighbors.knn(target, 12)
        target = target.join(geometry.normals(edges), "id")
        if method == "color":
            target = registration.color_gradients(target, edges)
    moved = (a + rng.normal(size=a.shape) * 0.002 - m[:3, 3]) @ m[:3, :3]  # inverse motion
    source = spark.createDataFrame([(k, *map(float, p), float(np.sin(4 * q[0]) + np.cos(5 * q[1]))) for k, (p, q) in enumerate(zip(moved, a, strict=True))], "id long, x double, y double, z double, i double")
    found, fitness, rmse = registration.icp(source, target, 0.15, iterations=20, method=method)
    error = registration.pose_error(found, motion)
    assert error["rotation_error_deg"] < 0.5 and error["translation_error"] < 0.03
    assert 0.7 < fitness < 1 and rmse < 0.08


def test_target_stays_where_it_is(spark):
    p = frame(spark, surfaces(300))
    with registration.matcher(p.select("id", "x", "y", "z"), 0.1) as pairs_of:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            met = pairs_of(registration.transform(p, registration.z_rotation(0.01)))
            plan = met._jdf.queryExecution().executedPlan().toString()
            got = {(r.src, r.dst) for r in met.collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(r.src, r.dst) for r in registration.correspondences(registration.transform(p, registration.z_rotation(0.01)), p, 0.1).collect()}
    scan = plan[plan.index("Bucketed: true") - 2000 : plan.index("Bucketed: true")]
    assert got == want and "Bucketed: true" in plan
    assert "Exchange" not in scan[scan.rindex("FileScan") - 200 :]


def test_crowded_target(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "DENSE", 3)
    p = frame(spark, surfaces(200))
    t = p.withColumns({c: F.lit(0.5) for c in ("nx", "ny", "nz", "gx", "gy", "gz")})
    with registration.matcher(t, 0.2, "color") as pairs_of:
        many = {tuple(r) for r in pairs_of(p).select("src", "dst", "d2", "si", "qi", "qnx").collect()}
    monkeypatch.setattr(neighbors, "DENSE", 512)
    with registration.matcher(t, 0.2, "color") as pairs_of:
        assert many == {tuple(r) for r in pairs_of(p).select("src", "dst", "d2", "si", "qi", "qnx").collect()}


def _nearest(source, target, distance):
    """{src: (dst, d2)} by brute force; ties go to the lower id."""
    near = {}
    for i, p in source:
        best = min(((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]), j) for j, q in target)
        if best[0] < distance * distance:
            near[i] = (best[1], best[0])
    return near


@pytest.mark.parametrize("hot", [False, True])
def test_held_equals_brute_force(spark, monkeypatch, hot):
    """Many leaves; places with many points, a lattice with ties, points far away and without a
    place; queries that are dealt to several tasks."""
    monkeypatch.setattr(partition, "LEAF", 16)
    monkeypatch.setattr(partition, "MARKS", 2)
    rng = np.random.default_rng(8)
    lattice = np.stack(np.meshgrid(*[np.arange(6) / 8] * 3), -1).reshape(-1, 3)
    xyz = np.vstack([rng.normal(size=(600, 3)) * 0.2, lattice, np.repeat(rng.random((3, 3)), 50, axis=0), [[90.0, 0, 0], [1e200, 0, 0]]])
    ids = rng.permutation(len(xyz)).tolist()
    asked = np.vstack([lattice + 1 / 16, xyz[::3] + 0.01, np.repeat(xyz[:1], 300, axis=0), [[90.0, 0.25, 0], [90.0, 0.2, 0]]])
    odd = [(None, 0.0, 0.0), (float("nan"), 0.0, 0.0), (0.0, float("inf"), 0.0), (0.0, 0.0, float("-inf"))]
    schema = "id long, x double, y double, z double, i double"
    rows = lambda names, points: [(n, *map(float, p), float(n)) for n, p in zip(names, points, strict=True)]
    none = [(10_000 + k, *p, 0.0) for k, p in enumerate(odd)]
    target = spark.createDataFrame(rows(ids, xyz) + none, schema).repartition(5)
    source = spark.createDataFrame(rows(range(len(asked)), asked) + none, schema).repartition(3)
    if hot:
        monkeypatch.setattr(partition, "QUERIES", 40)
    held = partition.Held(target.withColumn("n", F.col("i") * 2), ("n",))
    crowds = held.crowds(source, 0.25)
    assert bool(crowds) == hot and len(held.marks) > 20
    got = held.within(source, 0.25, ("i",), crowds).collect()
    want = _nearest(enumerate(asked.tolist()), list(zip(ids, xyz.tolist(), strict=True)), 0.25)
    assert {r.src: (r.dst, r.d2) for r in got} == want and len(got) == len(want)
    assert all(r.qn == 2.0 * r.dst and r.si == float(r.src) for r in got)
    empty = partition.Held(target.limit(0))
    assert empty.within(source, 0.25).count() == 0 and held.within(source.limit(0), 0.25).count() == 0


def test_a_step_in_a_dense_cloud_is_one_query(spark):
    """Cells hold hundreds of points: a step goes through a few leaves a point, in one query."""
    n = 16_000
    p = stored(spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(np.random.default_rng(5).random((n, 3)) * 0.3)], "id long, x double, y double, z double").repartition(3))
    sc = spark.sparkContext
    with registration.matcher(p, 0.1) as pairs_of:
        pairs_of(p)
        sc.setJobGroup("step", "a step")
        try:
            pairs = pairs_of(registration.transform(p, registration.z_rotation(0.001)))
            assert registration.step_sums(pairs).first().n == n
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(sc.statusTracker().getJobIdsForGroup("step")) <= 4  # one for each of its stages
    held = partition.Held(p)
    assert held._visits(p, 0.01, ()).count() < 8 * n


def test_compare(spark):
    """The whole clouds come back onto each other, the thinned ones nearly; points without a
    place count as misses."""
    p = frame(spark, surfaces(400)).select("id", "x", "y", "z")
    odd = spark.createDataFrame([(10_000, None, 0.0, 0.0), (10_001, float("nan"), 0.0, 0.0)], p.schema)
    motion = registration.axis_angle([0.0, 0.0, 1.0], 0.01, [0.004, -0.003, 0.002])
    s, t = p.unionByName(odd), registration.transform(p, motion).unionByName(odd)
    rows = compose.compare(s, t, s.where("id % 3 = 0"), t.where("id % 3 <> 1"), motion, iterations=8).collect()
    assert [(r.clouds, r.method) for r in rows] == [(c, m) for c in ("original", "simplified") for m in ("point", "plane")]
    for r in rows:
        assert r.rotation_error_deg < 0.2 and r.translation_error < 0.005 and r.inlier_rmse < 0.01
        assert r.fitness == 600 / 602
    assert all(r.rotation_error_deg < 1e-5 for r in rows[:2])
    found = registration.transform(s, motion)
    plain, there = (registration.evaluate(found, t, 0.2, held).first() for held in (None, partition.Held(t)))
    assert plain.fitness == there.fitness and math.isclose(plain.inlier_rmse, there.inlier_rmse, abs_tol=1e-12)


def test_no_pairs_and_unknown_methods(spark):
    p = frame(spark, surfaces(50))
    far = registration.transform(p, registration.axis_angle([0, 0, 1], 0.0, [100, 0, 0]))
    assert registration.icp(p, far, 0.1)[1:] == (0.0, 0.0)
    assert registration.icp(p.limit(0), p, 0.1)[0] == registration.IDENTITY
    with pytest.raises(ValueError):
        registration.icp(p, p, method="line")
    assert math.isclose(registration.rotation_angle(registration.z_rotation(0.3)), 0.3)


@pytest.mark.parametrize("unit", [1.0, 1000.0])
def test_wrong_matches(spark, unit):
    """Seven of ten matches are wrong, the clouds overlap in part; any unit."""
    rng = np.random.default_rng(6)
    motion = registration.axis_angle([1.0, -2.0, 0.5], 1.9, [3.0 * unit, -unit, 2.0 * unit])
    m = np.asarray(motion)
    s = rng.normal(size=(600, 3)) * unit
    t = s @ m[:3, :3].T + m[:3, 3] + rng.normal(size=s.shape) * 0.005 * unit
    wrong = rng.random(600) < 0.7
    t[wrong] = rng.normal(size=(int(wrong.sum()), 3)) * unit + m[:3, 3]
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(s, t, strict=True)] + [(None,) * 6], "sx double, sy double, sz double, tx double, ty double, tz double").repartition(3)
    found, hits = registration.ransac_matches(df, 0.03 * unit)
    error = registration.pose_error(found, motion)
    assert error["rotation_error_deg"] < 0.2 and error["translation_error"] < 0.01 * unit
    assert abs(hits - int((~wrong).sum())) <= 12
    few = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(s, np.where(wrong[:, None] & (rng.random(600) < 0.4)[:, None], t, s @ m[:3, :3].T + m[:3, 3]), strict=True)], df.schema)
    assert registration.pose_error(registration.solve_matches(few, 60), motion)["rotation_error_deg"] < 1.0


def test_too_few_matches(spark):
    cols = "sx double, sy double, sz double, tx double, ty double, tz double"
    assert registration.ransac_matches(spark.createDataFrame([], cols), 0.1) == (registration.IDENTITY, 0)
    assert registration.ransac_matches(spark.createDataFrame([(0.0,) * 6] * 5, cols), 0.1)[1] in (0, 5)
