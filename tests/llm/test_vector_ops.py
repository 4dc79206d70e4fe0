"""Clustering and hard negatives against brute force."""

import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from pointloom.llm import dualtree, hardneg, queries

SCHEMA = "vec_id long, embedding array<float>, label int"
DATA = "/root/testdata/sf0.001"


def clean(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def floors(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def brute_lloyd(rows, k, rounds, dims):
    kept = [(i, floors(v)) for i, v, *_ in rows if clean(v) and len(v) == dims]
    if not kept:
        return []
    first = sorted((sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c, x = np.array([v for _, v in first]), np.array([v for _, v in kept])

    def near():
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        to, _ = near()
        for j in range(len(c)):
            if (to == j).any():
                c[j] = x[to == j].sum(axis=0) // (to == j).sum()
    to, d = near()
    names = [sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return sorted((str(i), int(t), int(g), int(d[to == t].sum()), int(d.sum()), names[t]) for (i, _), t, g in zip(kept, to, d, strict=True))


def odd_rows(dims, rng):
    """Tight groups, copies, a far vector, ties, nulls, wrong sizes."""
    rows = []
    for g in range(9):
        mid = rng.normal(size=dims)
        rows += [(1000 * g + k, (mid + rng.normal(size=dims) * 10.0 ** -(g % 4)).tolist(), g % 4) for k in range(60)]
    rows += [(20_000 + k, [0.5] * dims, 1) for k in range(120)]
    rows += [(30_000, [90.0] * dims, 2), (30_001, [], 2), (30_002, None, 2), (30_003, [1.0] * (dims + 1), 2), (30_004, [1.0] * (dims - 1) + [None], 2), (30_005, [float("nan")] * dims, 2), (30_006, [float("inf")] + [0.0] * (dims - 1), 2)]
    rows += [(40_000, [float(s)] + [0.0] * (dims - 1), 3) for s in (-1, 1)] + [(None, [0.25] * dims, 3)] * 2
    return rows


def test_tree_invariants():
    rng = np.random.default_rng(5)
    x = np.array([v for _, v, _ in odd_rows(6, rng) if clean(v) and len(v) == 6])
    t = dualtree.cover_tree(x, 4)
    p = x[t.order]
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for n in range(len(t.lo)):
        inside = p[t.lo[n] : t.hi[n]]
        assert t.lo[n] <= t.centre[n] < t.hi[n]
        assert np.linalg.norm(inside - p[t.centre[n]], axis=1).max() == pytest.approx(t.radius[n])
        kids = range(t.first[n], t.first[n] + t.kids[n])
        assert sum(t.hi[k] - t.lo[k] for k in kids) + t.own[n] - t.lo[n] == t.hi[n] - t.lo[n]
        reach = t.radius[n] / dualtree.BASE
        if t.kids[n]:
            nets = [p[t.centre[k]] for k in kids] + list(p[t.lo[n] : t.own[n]])
            gaps = [np.linalg.norm(a - b) for i, a in enumerate(nets) for b in nets[:i]]
            assert all(g > reach for g in gaps) and all(t.radius[k] <= reach + 1e-12 for k in kids)


def test_pruning_compares_few_pairs():
    """On separate groups whole nodes go to one centroid without a comparison."""
    rng = np.random.default_rng(2)
    mids = rng.integers(-10_000, 10_000, (40, 8))
    x = (mids[:, None, :] + rng.integers(-40, 40, (40, 50, 8))).reshape(-1, 8)
    tree, c = dualtree.cover_tree(x.astype(float)), dualtree.Centroids(mids)
    to, wholes = dualtree.assigned(tree, x[tree.order], c)
    assert to.tolist() == (tree.order // 50).tolist()
    assert c.pairs < 0.05 * len(x) * 40 and sum(hi - lo for lo, hi in wholes) > 0.9 * len(x)


@pytest.mark.parametrize(("dims", "k", "rounds", "block"), [(6, 40, 5, 2048), (6, 7, 3, 100), (64, 40, 5, 300), (3, 2000, 2, 2048)])
def test_clusters_equal_brute_force(spark, monkeypatch, dims, k, rounds, block):
    monkeypatch.setattr(dualtree, "BLOCK", block)
    rows = odd_rows(dims, np.random.default_rng(dims))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cluster int, distance string").repartition(3)
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in dualtree.clusters(df, k, rounds, dims).collect())
    assert got == brute_lloyd(rows, k, rounds, dims)


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [1.0], 1)]):
        got = dualtree.clusters(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns[:3] == ["vec_id", "cluster", "distance"]


def test_large_components_are_exact(spark):
    big = [float(2**17), float(-(2**17)), float(2**17 - 1), 0.0]
    rng = random.Random(1)
    rows = [(k, [rng.choice(big) for _ in range(8)], 0) for k in range(200)]
    got = sorted((str(r.vec_id), r.cluster, r.distance) for r in dualtree.clusters(spark.createDataFrame(rows, SCHEMA), 5, 2, 8).collect())
    assert got == [r[:3] for r in brute_lloyd(rows, 5, 2, 8)]
    with pytest.raises(Exception, match="64 bits"):
        dualtree.clusters(spark.createDataFrame([(1, [1e30] * 8, 0)], SCHEMA), 5, 2, 8).collect()


@pytest.mark.parametrize("name", ["op11_dual_tree_clusters", "op13_pivot_hard_negatives"])
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = queries.queries()[name](spark, DATA)
    want = duck.sql(queries.oracle_sql()[name]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(want.astype(object).itertuples(index=False, name=None))


def brute_negatives(rows, positives=5, negatives=3):
    kept = []
    for n, (i, v, label) in enumerate(rows):
        if label is not None and clean(v):
            kept.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, floors(v)))
    name = lambda i: (i is None, i or 0)
    out = []
    for n, a, al, q in kept:
        if a is None or a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), name(i), m, i, lab) for m, i, lab, v in kept if m != n)
        for ps, _, _, p, _ in [r for r in scored if r[4] == al][:positives]:
            hard = [r for r in scored if r[4] != al and 50 * -ps <= 100 * -r[0] <= 95 * -ps][:negatives]
            out += [(a, p, k + 1, r[3], -ps, -r[0]) for k, r in enumerate(hard)]
    return sorted(out, key=str)


def mined(df, **more):
    return sorted((tuple(r) for r in hardneg.mine(df, **more).collect()), key=str)


@pytest.mark.parametrize(("resident", "stream", "box"), [(4096, 262_144, 128), (3, 40, 5)])
def test_negatives_equal_brute_force(spark, monkeypatch, resident, stream, box):
    """Groups, copies, ties, one label with a third of the rows, missing and odd values."""
    for name, v in (("RESIDENT", resident), ("STREAM", stream), ("BOX", box)):
        monkeypatch.setattr(hardneg, name, v)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(8):
        mid = rng.normal(size=6) * 2
        rows += [(37 * g + 8 * k, (mid + rng.normal(size=6) * 0.5).tolist(), int(rng.choice([1, 1, 1, 2, 3, 9, -4, 12]))) for k in range(40)]
    rows += [(50 * k, [1.0, 2.0, 0.5, 0.0, 0.0, 0.0], k % 3) for k in range(30)] + [(50, [1.0, 2.0, 0.5, 0.0, 0.0, 0.0], 1)] * 3
    rows += [(5000, [0.0] * 6, 1), (5050, [1.0], 2), (5100, [], 3), (5150, None, 1), (5200, [1.0] * 6, None), (5250, [float("nan")] * 6, 1), (5300, [None] + [1.0] * 5, 1), (5350, [float("inf")] * 6, 1), (5400, [1.0] * 9, 2), (None, [1.0, 2.0, 0.5, 0.0, 0.0, 0.0], 1), (None, [1.0, 2.0, 0.5, 0.0, 0.0, 0.0], 2), (5450, [-3.0] * 6, 77)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", `row` int, p int, slot string").repartition(3)
    assert mined(df) == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(51, [1.0], 1), (52, [1.0], 1)], SCHEMA)) == []


def test_brackets_leave_few_pairs():
    """On separate groups most pairs are settled by their distances to the pivots."""
    rng = np.random.default_rng(4)
    mids = rng.integers(-2000, 2000, (8, 16))
    x = (mids[:, None, :] + rng.integers(-20, 20, (8, 400, 16))).reshape(-1, 16)
    norm2 = int((x * x).sum(axis=1).max())
    held = hardneg.pivots(x[::40], norm2, 8)
    anchors = hardneg.Anchors(x[::100], held, norm2)
    least, most = (x[::100] ** 2).sum(axis=1) * 0.9, np.full(len(x[::100]), 2.0**60)
    far = hardneg.to_pivots(hardneg.augmented(x, norm2), held)
    found = set()
    for who, at, mask in anchors.survivors(far, least, most):
        found |= {(int(who[i]), at.start + int(j)) for i, j in zip(*np.nonzero(mask), strict=True)}
    score = x[::100] @ x.T
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(score >= least[:, None]), strict=True)} <= found
    assert anchors.checked < 0.5 * anchors.met
