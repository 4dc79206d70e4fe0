"""Components against union-find, regions against growing them point by point."""

import math

import numpy as np
import pytest

from pointloom.operators import regions


def union(pairs):
    up = {}

    def root(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {a: root(a) for a in list(up)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components_equal_union_find(spark, kind):
    rng = np.random.default_rng(5)
    pairs = {"random": rng.integers(0, 400, (330, 2)).tolist(), "path": [[k, k + 1] for k in range(0, 200)] + [[1000 - k, 999 - k] for k in range(100)], "star": [[7, k] for k in range(100)] + [[3, 3]], "none": []}[kind]
    df = spark.createDataFrame([(*map(int, p),) for p in pairs] + [(None, 5)], "src long, dst long").repartition(3)
    assert {r.id: r.label for r in regions.components(df).collect()} == union(pairs)


def grown(points, edges, angle, flat, least):
    near = {i: set() for i in points}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    along = lambda a, b: abs(float(points[a][0] @ points[b][0]))
    out = {}
    for seed in sorted(points):
        if points[seed][1] >= flat or seed in out:
            continue
        todo, out[seed] = [seed], seed
        while todo:
            a = todo.pop()
            for b in near[a]:
                if b not in out and points[b][1] < flat and along(a, b) > math.cos(angle):
                    out[b] = seed
                    todo.append(b)
    rim = {}
    for a in points:
        fits = [(-along(a, b), b) for b in near[a] if points[b][1] < flat and along(a, b) > math.cos(angle)]
        if points[a][1] >= flat and fits:
            rim[a] = out[min(fits)[1]]
    out |= rim
    sizes = {r: list(out.values()).count(r) for r in set(out.values())}
    return {i: (out[i], sizes[out[i]]) if i in out and sizes[out[i]] >= least else (None, None) for i in points}


@pytest.mark.parametrize(("angle", "flat", "least"), [(0.5, 0.6, 1), (0.9, 0.4, 4), (0.2, 0.0, 1)])
def test_regions_equal_growing(spark, angle, flat, least):
    rng = np.random.default_rng(8)
    normals = rng.normal(size=(150, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    points = {3 * k: (n, float(c)) for k, (n, c) in enumerate(zip(normals, rng.random(150), strict=True))}
    edges = [(3 * int(a), 3 * int(b)) for a, b in rng.integers(0, 150, (900, 2))]
    df = spark.createDataFrame([(i, *map(float, n), c) for i, (n, c) in points.items()], "id long, nx double, ny double, nz double, curvature double")
    got = regions.grow(df, spark.createDataFrame(edges, "src long, dst long"), angle, flat, least)
    assert {r.id: (r.region, r.size) for r in got.collect()} == grown(points, edges, angle, flat, least)
