"""Hand-made clouds, dense numpy results and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import spatial
from pointloom.operators import compose, geometry, graph, neighbors, registration, sampling, smoothing


def cloud(spark, xyz):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "id long, x double, y double, z double")


def matrix(df, cols=("x", "y", "z")):
    return np.array([[r[c] for c in cols] for r in df.orderBy("id").collect()])


@pytest.fixture(scope="module")
def random_xyz():
    return np.random.default_rng(3).random((120, 3))


def brute(q, t, radius, k):
    out = set()
    for i, p in enumerate(q):
        d2 = ((p[0] - t[:, 0]) * (p[0] - t[:, 0]) + (p[1] - t[:, 1]) * (p[1] - t[:, 1])) + (p[2] - t[:, 2]) * (p[2] - t[:, 2])
        order = sorted((d, j) for j, d in enumerate(d2) if d < radius * radius)[:k]
        out |= {(i, j, n + 1) for n, (_, j) in enumerate(order)}
    return out


@pytest.mark.parametrize("radius,k,dense", [(0.3, 5, 512), (0.3, 5, 10), (0.2, 50, 2), (2.0, 3, 4)])
def test_hybrid_equals_brute_force(spark, monkeypatch, random_xyz, radius, k, dense):
    monkeypatch.setattr(neighbors, "DENSE", dense)
    got = {(r.src, r.dst, r.rn) for r in neighbors.hybrid(cloud(spark, random_xyz), radius, k).collect()}
    assert got == brute(random_xyz, random_xyz, radius, k)


def test_knn_equals_brute_force(spark, random_xyz):
    far = random_xyz[:20] + 5
    got = {(r.src, r.dst, r.rn) for r in neighbors.knn(cloud(spark, far), 4, cloud(spark, random_xyz)).collect()}
    assert got == brute(far, random_xyz, 1e9, 4)


def test_dense_cell_starts_finer(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "DENSE", 20)
    xyz = np.random.default_rng(1).random((200, 3)) * 0.3
    got = {(r.src, r.dst, r.rn) for r in neighbors.hybrid(cloud(spark, xyz), 0.3, 2).collect()}
    assert got == brute(xyz, xyz, 0.3, 2)


@pytest.mark.parametrize("kind", ["outlier", "cluster", "coinciding"])
def test_search_on_uneven_clouds(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbors, "DENSE", 30)
    rng = np.random.default_rng(5)
    more = {"outlier": np.array([[1e6, -1e6, 0.0]]), "cluster": rng.random((150, 3)) * 1e-3 + 0.5, "coinciding": np.full((150, 3), 0.25)}[kind]
    xyz = np.vstack([rng.random((150, 3)), more])
    got = {(r.src, r.dst, r.rn) for r in neighbors.knn(cloud(spark, xyz), 4).collect()}
    assert got == brute(xyz, xyz, 1e9, 4)
    got = {(r.src, r.dst, r.rn) for r in neighbors.hybrid(cloud(spark, xyz), 0.2, 4).collect()}
    assert got == brute(xyz, xyz, 0.2, 4)


def test_coinciding_points_are_linear(spark):
    p = cloud(spark, np.full((5000, 3), 2.0))
    assert neighbors.knn(p, 3).groupBy("dst").count().orderBy("dst").collect() == [(0, 5000), (1, 5000), (2, 5000)]


def test_feature_match_at_near_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "RESIDENT", 40)
    monkeypatch.setattr(neighbors, "STREAM", 30)
    rng = np.random.default_rng(2)
    far = 1e8 + rng.integers(0, 3, (100, 4))  # products cancel there
    a = spark.createDataFrame([(k, v.astype(float).tolist()) for k, v in enumerate(far[:60])] + [(900, None)], "id long, feature array<double>")
    b = spark.createDataFrame([(k, v.astype(float).tolist()) for k, v in enumerate(far[40:])], "id long, feature array<double>")
    got = {r.id0: (r.id1, r.dist) for r in neighbors.feature_match(a, b).collect()}
    want = {}
    for k, v in enumerate(far[:60]):
        d = np.sqrt(((v - far[40:]) ** 2).sum(axis=1))
        want[k] = (int(d.argmin()), float(d.min()))
    assert got == want
    assert neighbors.feature_match(a, b.where("id < 0")).count() == 0


def test_ranks_and_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    v, t = rng.integers(0, 40, 300) / 7, np.exp(rng.normal(size=500) * 3)  # ties; a heavy tail
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "id long, score double")
    order = sorted(range(300), key=lambda k: (-v[k], k))
    assert {r.id for r in sampling.feature_band(df, 0.01, 0.3).where("feature").collect()} == set(order[3:93])
    s, n = np.unique(v, return_counts=True)
    u, m = np.unique(t, return_counts=True)
    mapped = dict(zip(s.tolist(), np.interp(np.cumsum(n) / 300, np.cumsum(m) / 500, u).tolist(), strict=True))
    got = sampling.hist_match(df.withColumnRenamed("score", "v"), spark.createDataFrame([(float(x),) for x in t], "v double")).collect()
    assert len(got) == 300 and all(r.out == pytest.approx(mapped[r.v]) for r in got)


def test_largest_eigenvalue_and_haar(spark, random_xyz):
    p, w = cloud(spark, random_xyz), dense(random_xyz, 0.3, 8)
    top = np.abs(np.linalg.eigvals(w)).max()
    adj = graph.adjacency(p, 0.3, 8)
    assert graph.largest_eigenvalue(p, adj) == pytest.approx(top, rel=1e-5)
    assert np.allclose(matrix(graph.haar_low_pass(p, adj)), random_xyz + w @ random_xyz / top, atol=1e-5)


def test_batches_lookup_and_paint(spark, random_xyz):
    p = cloud(spark, random_xyz)
    got = compose.score_cloud(p, 0.4, 6, 50)
    parts = [compose.score_cloud(p.where(f"id >= {a} AND id < {a + 50}"), 0.4, 6) for a in (0, 50, 100)]
    want = {r.id: r.score for x in parts for r in x.collect()}
    assert {r.id: r.score for r in got.collect()} == pytest.approx(want)
    assert compose.sample_cloud(p, 0.4, 6, 10, batch_size=50).count() == 10
    assert set(r.part for r in compose.sample_cloud(p, 0.4, 6, method="smooth").collect()) == {"feature", "smooth"}
    assert compose.paint(p, (0, 0.5, 1)).select("r", "g", "b").distinct().collect() == [(0.0, 0.5, 1.0)]
    table = spark.createDataFrame([(k, f"n{k}") for k in range(119)], "id long, name string")
    assert compose.lookup(p.where("id < 119"), table, "id").where("name IS NOT NULL").count() == 119
    with pytest.raises(Exception, match="no entry for 119"):
        compose.lookup(p, table, "id").collect()


def test_coarse_and_fine_runs_recover_a_motion(spark):
    rng = np.random.default_rng(1)
    xyz = rng.random((200, 3))
    truth = registration.axis_angle([0, 0, 1], 0.02, [0.01, 0.0, -0.01])
    p = cloud(spark, xyz).select("*", F.array("x", "y", "z", F.col("id") / 100).alias("feature"), *[(F.col("id") % m / m).alias(c) for c, m in zip("rgb", (7, 5, 3), strict=True)])
    t = registration.transform(p, truth)
    # every fifth match is wrong, the others are noisy
    noisy = t.withColumns({c: F.col(c) + F.when(F.col("id") % 5 == 0, 0.5).otherwise((F.col("id") % 3 - 1) * 1e-3) for c in "xyz"})
    _, errors = compose.coarse_run(p, noisy, registration.random_pose(2, 1.0), truth, ratios=(50.0, 50.0))
    assert errors["rotation_error_deg"] < 3 and errors["translation_error"] < 0.1
    runs = compose.fine_registration(p, t, p, t, registration.IDENTITY, truth, voxel=0.01, radius=0.5, k=30, iterations=30).collect()
    assert [r.run for r in runs] == ["simplified", "whole", "colored"] and all(r.rotation_error_rad < 0.02 for r in runs)


def test_collinear_ranks_and_ties(spark):
    line = cloud(spark, [(k, 0, 0) for k in range(5)])
    e = neighbors.hybrid(line, 1.5, 3)
    assert [(r.dst, r.d2) for r in e.where("src = 2").orderBy("rn").collect()] == [(2, 0.0), (1, 1.0), (3, 1.0)]
    adj = graph.adjacency(line, 1.5, 3)
    assert {r.id: round(r.degree, 9) for r in graph.degree(adj).collect()} == {k: round(n * math.exp(-1), 9) for k, n in enumerate((2, 3, 3, 3, 2))}
    assert matrix(graph.filtered(line, adj), ("fx",))[2, 0] == pytest.approx(0)


def test_radius_is_strict_on_a_lattice(spark):
    grid = cloud(spark, [(i, j, k) for i in range(3) for j in range(3) for k in range(3)])
    assert neighbors.radius_join(grid, 1.0).count() == 27
    assert neighbors.radius_join(grid, 1.0001).where("src = 13").count() == 7


def test_coinciding_and_isolated_points(spark):
    p = cloud(spark, [(0, 0, 0), (0, 0, 0), (9, 9, 9)])
    adj = graph.adjacency(p, 1.0, 5, "gauss")
    assert adj.count() == 0
    low = graph.filtered(p, adj, "low")
    assert matrix(low, ("fx",))[2, 0] == 9.0 and matrix(low, ("k",))[2, 0] == 0
    assert matrix(graph.filtered(p, adj), ("fx", "fy", "fz")).tolist() == [[0.0] * 3] * 3


def test_empty_cloud(spark):
    p = cloud(spark, [(0, 0, 0)]).where("id < 0")
    assert neighbors.hybrid(p, 1.0, 3).count() == 0
    assert neighbors.knn(p, 3).count() == 0
    assert graph.high_pass_score(p, 1.0, 3).count() == 0
    assert sampling.voxel_downsample(p, 1.0).count() == 0
    assert registration.evaluate(p, p).first().inlier_rmse == 0.0


def dense(xyz, radius, k):
    n = len(xyz)
    w = np.zeros((n, n))
    for i, j, _ in brute(xyz, xyz, radius, k):
        w[i, j] = math.exp(-1)
    return w


def test_score_equals_dense_and_is_invariant(spark, random_xyz):
    w = dense(random_xyz, 0.25, 8)
    want = (((np.diag(w.sum(1)) - w) @ random_xyz) ** 2).sum(1)
    p = cloud(spark, random_xyz)
    assert np.allclose(matrix(graph.high_pass_score(p, 0.25, 8), ("score",))[:, 0], want)
    moved = registration.transform(p, registration.axis_angle([1, 1, 0], 0.4, [3, 1, 2]))
    assert np.allclose(matrix(graph.high_pass_score(moved, 0.25, 8), ("score",))[:, 0], want)
    assert np.allclose(matrix(graph.score(graph.filtered(p, graph.adjacency(p, 0.25, 8))), ("score",))[:, 0], want)
    flat = p.withColumns({c: F.lit(2.5) for c in "xyz"})
    adj = graph.adjacency(p, 0.25, 8).withColumns({c: F.lit(2.5) for c in ("sx", "sy", "sz", "tx", "ty", "tz")})
    assert np.allclose(matrix(graph.filtered(flat, adj), ("fx", "fy", "fz")), 0)


def test_smoother_solves_the_system(spark, random_xyz):
    p, w = cloud(spark, random_xyz), dense(random_xyz, 0.25, 8)
    mask = p.select("id", (F.col("id") % 7 == 0).alias("feature"))
    s = np.diag((np.arange(len(random_xyz)) % 7 == 0).astype(float))
    lap, eye = np.diag(w.sum(1)) - w, np.eye(len(random_xyz))
    want = np.linalg.solve(0.1 * lap + 0.9 * (s + 0.8 * eye), 0.9 * (s + 0.8 * eye) @ random_xyz)
    assert np.allclose(matrix(smoothing.smooth(p, graph.adjacency(p, 0.25, 8), mask)), want, atol=1e-6)


def test_conjugate_gradients_solve_the_squared_system(spark, random_xyz):
    xyz = random_xyz[:40]
    p, w = cloud(spark, xyz), dense(xyz, 0.4, 6)
    lap, eye = np.diag(w.sum(1)) - w, np.eye(len(xyz))
    want = np.linalg.solve(0.05 * lap.T @ lap + 0.95 * eye, 0.95 * xyz)
    assert np.allclose(matrix(smoothing.smooth_squared(p, graph.adjacency(p, 0.4, 6))), want, atol=1e-5)


def test_geometry_equals_numpy(spark, random_xyz):
    p = cloud(spark, random_xyz)
    e = graph.edges(p, 0.3, 12)
    near = {}
    for i, j, _ in brute(random_xyz, random_xyz, 0.3, 12):
        near.setdefault(i, []).append(random_xyz[j])
    normals = matrix(geometry.normals(e), ("nx", "ny", "nz"))
    curv = matrix(geometry.curvature(e), ("curvature",))[:, 0]
    for i, q in near.items():
        c = np.cov(np.array(q).T, bias=True) if len(q) > 2 else np.eye(3)
        values, vectors = np.linalg.eigh(c)
        assert curv[i] == pytest.approx(values[0] / values.sum(), abs=1e-7)
        if len(q) > 4:
            assert abs(normals[i] @ vectors[:, 0]) == pytest.approx(1, abs=1e-6)
    a, b, c, d = geometry.plane_fit(cloud(spark, [(x, y, 2 * x - y + 3) for x in range(4) for y in range(4)]))
    assert abs(d / c) == pytest.approx(3)


def test_raised_point_is_the_feature(spark):
    grid = [(x, y, 0.5 if (x, y) == (3, 3) else 0.0) for x in range(7) for y in range(7)]
    top = graph.high_pass_score(cloud(spark, grid), 1.6, 9).orderBy(F.desc("score")).first()
    assert grid[top.id][2] == 0.5


def test_transform_and_pose(spark, random_xyz):
    quarter = registration.z_rotation(math.pi / 2)
    assert np.allclose(np.asarray(quarter)[:3, :3] @ [1, 0, 0], [0, 1, 0])
    p = cloud(spark, random_xyz)
    m = registration.random_pose(5)
    back = registration.transform(registration.transform(p, m), registration.inverse(m))
    assert np.allclose(matrix(back), random_xyz, atol=1e-9)
    same = registration.pose_error(m, m)
    assert same["rotation_error_deg"] == pytest.approx(0, abs=1e-5) and same["translation_error"] == pytest.approx(0, abs=1e-9)
    turned = registration.pose_error(quarter, registration.IDENTITY)
    assert turned["rotation_error_deg"] == pytest.approx(90) and turned["rotation_error_rad"] == pytest.approx(math.pi / 2)


def test_registration_of_a_shifted_cloud(spark, random_xyz):
    p = cloud(spark, random_xyz)
    fit = registration.evaluate(p, p).first()
    assert (fit.fitness, fit.inlier_rmse) == (1.0, 0.0)
    shifted = registration.transform(cloud(spark, random_xyz * 10), registration.axis_angle([0, 0, 1], 0.0, [0.05, 0, 0]))
    found, fitness, rmse = registration.icp(cloud(spark, random_xyz * 10), shifted, 0.3, iterations=5)
    assert np.allclose(np.asarray(found)[:3, 3], [0.05, 0, 0], atol=1e-6) and fitness == 1 and rmse == pytest.approx(0, abs=1e-6)


def test_opposite_axes_align(spark):
    a = cloud(spark, [(t, 0.01 * (t % 2), 0) for t in range(9)])
    m = np.asarray(registration.pca_align(a, registration.transform(a, registration.z_rotation(math.pi / 3))))
    assert np.linalg.det(m[:3, :3]) == pytest.approx(1)


def test_sampling(spark):
    s = spark.createDataFrame([(k, float(v)) for k, v in enumerate((5, 1, 9, 9, 3, 0))], "id long, score double")
    n = sampling.normalize_clamp(s)
    assert {r.id for r in n.where("g = 1").collect()} == {2, 3}
    assert [r.id for r in sampling.topk(n, 2).collect()] == [0, 4]
    assert [r.id for r in sampling.topk_extremes(s, 1).collect()] == [2, 5, 1]
    band = sampling.feature_band(s, 0.2, 0.4)
    assert {r.id for r in band.where("feature").collect()} == {3, 0}
    assert sampling.feature_band(s, 0.0, 0.0).where("feature").count() == 0
    with pytest.raises(ValueError):
        sampling.sample_points(n, 1, "other")
    drawn = [r.id for r in sampling.weighted_sample(s, 3, seed=1).collect()]
    assert len(set(drawn)) == 3 and 5 not in drawn


def test_equal_scores_normalise_to_zero(spark):
    s = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id long, score double")
    assert [r.norm for r in sampling.normalize_clamp(s).orderBy("id").collect()] == [0.0, 0.0, None]


def test_cloud_algebra(spark):
    p = cloud(spark, [(0, 0, 0), (1, 1, 1)])
    colored = p.withColumns({c: F.lit(0.2) for c in "rgb"})
    assert compose.merge(colored, colored).where("r = 0.2").count() == 4
    assert compose.merge(colored, p).where("r is null").count() == 4
    with pytest.raises(ValueError):
        compose.merge()
    cls = spark.createDataFrame([(1, 0), (2, 5), (3, None)], "id long, cls int")
    assert compose.of_classes(cls, [0]).count() == 1 and compose.of_classes(cls, [0], keep=False).count() == 2
    with pytest.raises(ValueError):
        graph.filtered(p, graph.adjacency(p, 1.0, 3), "other")


def test_plans_stay_equi_joins(spark, random_xyz):
    p = cloud(spark, random_xyz)
    plan = graph.high_pass_score(p, 0.2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spatial.XYZ == ("x", "y", "z")


def test_ransac_finds_the_plane(spark):
    rng = np.random.default_rng(2)
    flat = np.c_[rng.random((80, 2)), np.zeros(80)]
    found = registration.ransac_planes(cloud(spark, np.r_[flat, rng.random((20, 3)) + 1]), 0.01, 40, 50, 2, 3)
    assert len(found) == 1 and found[0]["inliers"] >= 80


def naive_classes(rows, radius):
    ids = sorted(r[0] for r in rows)
    place = {r[0]: r[1:] for r in rows}
    near = {a: [] for a in ids}
    for a in ids:
        for b in ids:
            p, q = place[a], place[b]
            if a != b and None not in p + q and sum((u - v) * (u - v) for u, v in zip(p, q, strict=True)) < radius * radius:
                near[a].append(b)
    label = {}
    for a in ids:
        todo = [] if a in label else [a]
        while todo:
            if (b := todo.pop()) not in label:
                label[b] = a
                todo += near[b]
    return sorted((a, label[a], len(near[a])) for a in ids)


@pytest.mark.parametrize(("radius", "held", "met"), [(0.15, 65_536, 131_072), (0.3, 40, 90), (1.0, 65_536, 131_072)])
def test_radius_classes_equal_brute_force(spark, monkeypatch, radius, held, met):
    monkeypatch.setattr(neighbors, "HELD", held)
    monkeypatch.setattr(neighbors, "MET", met)
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.normal(0, 0.4, (250, 3)), rng.integers(-4, 5, (150, 3)) * radius, np.tile([[2.0, -2.0, 2.0]], (60, 1)), rng.uniform(-30, 30, (40, 3))]).tolist()
    huge = [[1e300, 0.0, 0.0], [1e300, 0.0, radius / 2], [-1e17, 1.0, 1.0], [-1e17, 1.0, 1.0], [1e17, 1.0, 1.0], [9.0e15, 0.0, 0.0], [9.0e15 + 2, 0.0, 0.0]]
    odd = [[None, 0.0, 0.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [-0.0, 0.0, 0.0]]
    rows = [(k * 7 - 300, *p) for k, p in enumerate(at + huge + odd)]
    got = neighbors.radius_classes(spark.createDataFrame(rows, "id long, x double, y double, z double"), radius)
    assert got.columns == ["id", "class_id", "links"]
    assert sorted(map(tuple, got.collect())) == naive_classes(rows, radius)


def test_radius_classes_have_a_row_for_each_point_and_all_links(spark):
    grid = spark.range(900).select("id", *[(F.col("id") % n / 100).cast("double").alias(c) for c, n in (("x", 10), ("y", 9), ("z", 10))])
    got = neighbors.radius_classes(grid, 1.0)
    pairs = neighbors.radius_join(grid, 1.0).where("src <> dst")
    assert got.count() == 900 and got.agg(F.sum("links")).first()[0] == pairs.count() == 900 * 899
    assert got.select("class_id").distinct().collect() == [(0,)]
    assert neighbors.radius_classes(grid.limit(0), 1.0).count() == 0
