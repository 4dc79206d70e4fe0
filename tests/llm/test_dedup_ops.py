"""Near-duplicates, repeated substrings, quality, the pipeline."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import neardup, quality, substrings


def brute_repeats(rows, length=400):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((str(i), len(b), int(gone.sum()), runs, sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("crowd", "load", "length"), [(2000, 1 << 22, 400), (5, 1 << 22, 400), (2000, 3000, 400), (2000, 1 << 22, 100)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd, load, length):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", load)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc de") for _ in range(n))
    a = word(900)
    rows = [(1, "a" * 3000), (2, None), (3, ""), (4, "ab" * 700), (5, a), (6, a[:500] + "X" + a[501:]), (7, "z" + a[100:650] + "y"), (8, a), (8, a), (9, "é" * 450), (10, "ü" * 399 + "x" + "é" * 210), (11, a[:399]), (12, "q" * 400), (13, "Q" + a[200:599]), (14, "Q" + a[200:600]), (None, word(500)), (15, "no" * 199)]
    rows += [(100 + k, word(300) + a[:390] + word(300)) for k in range(30)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rank long, spans_n int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(df, length=length).collect())
    assert got == brute_repeats(rows, length)


def test_crowded_buckets_give_runs(spark, monkeypatch):
    """A stretch of a crowded bucket is one row with its maximal runs, not a row a start."""
    monkeypatch.setattr(substrings, "CROWD", 5)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a = word(900)
    rows = [(k, a[: 20 * k] + "#" + word(3) + a[20 * k + 4 :]) for k in range(1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made, dealt = [], substrings.dealt_suffixes
    monkeypatch.setattr(substrings, "dealt_suffixes", lambda *a: made.append(dealt(*a)) or made[-1])
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(df).collect())
    assert got == brute_repeats(rows)
    runs = [[tuple(x) for x in r.runs] for r in made[0].collect()]
    assert runs and all(lo < hi for r in runs for lo, hi in r)
    assert all(x[1] < y[0] for r in runs for x, y in zip(r, r[1:]))  # apart, in order
    keys = substrings.repeated_spans(df.selectExpr("doc_id AS k1", "doc_id AS k2", "text"))
    assert "Generate explode(runs" not in keys._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("crowd", "length", "letters", "ends"), [(2000, 400, " '", ("", "", "", "")), (2000, 512, "!A", ("-", "-+", "=", "=%")), (0, 512, "!A", ("-", "-+", "=", "=%"))])
def test_regular_texts_that_differ_stay(spark, monkeypatch, crowd, length, letters, ends):
    """Thue-Morse words of 512 letters, on which every polynomial modulo 2^64 may agree: as
    whole stretches, in a sorted bucket and among dealt suffixes."""
    monkeypatch.setattr(substrings, "CROWD", crowd)
    words = ["".join(p[k.bit_count() & 1] for k in range(512)) for p in (letters, letters[::-1])]
    rows = [(0, ends[0] + words[0] + ends[1]), (1, ends[2] + words[1] + ends[3])]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect())
    assert got == brute_repeats(rows, length)
    assert [g[2] for g in got] == [0, 0]


def test_names_tell_regular_texts_apart():
    bits = np.array([k.bit_count() & 1 for k in range(1024)])
    for a, b in ((32, 39), (97, 98), (48, 49), (65, 113)):
        raw = np.concatenate([np.where(bits, a, b), np.where(bits, b, a)]).astype(np.uint8)
        for length in (128, 400, 512, 1024):
            start = np.arange(len(raw) - length + 1)
            names = substrings.Namer().names(raw, start, length)
            assert len(np.unique(names)) == len({raw[k : k + length].tobytes() for k in start})
            assert len({(int(n), raw[k : k + length].tobytes()) for n, k in zip(names, start)}) == len(np.unique(names))


def test_cut_keeps_odd_columns(spark):
    t = "".join(random.Random(1).choice("abcdef ") for _ in range(500))
    df = spark.createDataFrame([(1, "x" + t, 1, 2, 3, 4), (2, t + "y", 1, 2, 3, 4)], "doc_id long, text string, spans_ int, k1 int, k1_ int, `to.1` int")
    got = substrings.without_repeats(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "x", 1, 2, 3, 4), (2, "y", 1, 2, 3, 4)]


def test_cut_keeps_columns(spark):
    t = "".join(random.Random(1).choice("abcdef ") for _ in range(500))
    df = spark.createDataFrame([(1, "x" + t, "en"), (2, t + "y", None), (3, None, "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[1].lang) == ("x", "y", None, "en")
    assert substrings.digests(df.where("doc_id = 0")).count() == 0


def test_long_texts_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh") for _ in range(700))
    rows = [(k, "".join(rng.choice("abcdefgh") for _ in range(1800)) + a + "".join(rng.choice("abcdefgh") for _ in range(2500 + k))) for k in range(3)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows)


def shingles(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    line = " ".join(word() for _ in range(30))  # in every document
    rows = []
    for k in range(25):
        base = [word() for _ in range(200)]
        rows.append((10 * k, line + " " + " ".join(base)))
        for j in (1, 2):
            near = list(base)
            for _ in range(j):
                near[rng.randrange(200)] = word()
            rows.append((10 * k + j, line + " " + " ".join(near)))
        rows.append((10 * k + 3, line + " " + " ".join(base)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "one two"), (1004, "one, TWO!"), (1005, "three"), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, label int, node string")
    got = neardup.classes(df).collect()
    assert len(got) == len(rows)
    label = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    for k in range(25):
        assert {label[10 * k + j] for j in range(4)} == {10 * k}
    assert label[1000] == label[1001] == 1000 and label[1002] == 1002
    assert label[1004] == 1003 and label[1005] == 1005
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([10 * k for k in range(25)] + [1000, 1002, 1003, 1005])
    assert neardup.classes(df.where("doc_id = -1")).count() == 0


def test_classes_are_right_on_random_edits(spark):
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = []
    for k in range(40):
        t = list(base)
        for _ in range(rng.randrange(12)):
            t[rng.randrange(120)] = str(rng.randrange(10**6))
        rows.append((k, " ".join(t)))
    sets = {i: shingles(t) for i, t in rows}
    label = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9:
                assert label[a] == label[b]


def brute_classes(rows, weights):
    """Components of all pairs of exact weighted Jaccard similarity 0.8 or more."""
    sh = neardup.Shingler()
    sets = []
    for _, t in rows:
        _, s, tf = sh.weighted([t or ""])
        sets.append(dict(zip(s.tolist(), weights(s, tf).astype(float).tolist(), strict=True)))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            least = sum(min(w, sets[b][x]) for x, w in sets[a].items() if x in sets[b])
            union = sum(sets[a].values()) + sum(sets[b].values()) - least
            if rows[a][1] == rows[b][1] or (union and least / union >= 0.8):
                x, y = label[a], label[b]
                label = [x if v == y else v for v in label]
    return sorted(sorted(str(rows[k][0]) for k in range(len(rows)) if label[k] == v) for v in set(label))


def test_classes_equal_brute_force_on_weighted_sets(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    line = [word() for _ in range(40)]  # boilerplate of most documents, so its weight is low
    rows = []
    for g in range(30):
        base = [word() for _ in range(90)]
        for j in range(7):  # edits on both sides of the threshold, some words repeated
            t = list(base)
            for _ in range(rng.randrange(6)):
                t[rng.randrange(90)] = word()
            t = t[:50] + t[:10] + t[50:]
            rows.append((10 * g + j, " ".join((line if g % 4 else []) + t)))
    rows += [(900 + k, " ".join(line + [word() for _ in range(12)])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.document_frequencies(df)
    weights = neardup.Weights(found, len(rows))
    assert found.sum() == 2 * sum(len(set(neardup.Shingler().weighted([t])[1].tolist())) for _, t in rows)
    common = neardup.Shingler().weighted([" ".join(line)])[1]
    assert (weights(common, np.ones(len(common), np.float32)) < 0.7).all()
    want = brute_classes(rows, weights)
    got = {}
    for r in neardup.classes(df).collect():
        got.setdefault((r.class_id, r.class_th), []).append(str(r.doc_id))
    assert sorted(map(sorted, got.values())) == want
    assert len([c for c in want if len(c) > 1]) > 20 and len(want) > 60


def test_odd_column_names_and_a_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long, 5, 6, 7, 8, 9), (2, long + " x", 5, 6, 7, 8, 9), (3, "a b", 5, 6, 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id long, keep_th_ long, first_id long, own_th long, `a.b` int")
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in (rows[0], rows[2]))


def bucket_of(spark, found):
    """Members of one bucket and sets for {name: shingles}."""
    members = spark.createDataFrame([(0, 0, bytearray(n)) for n in found], "band int, key long, node binary")
    sets = spark.createDataFrame([(bytearray(n), bytearray(np.array(sorted(s), np.uint64).tobytes()), None, float(len(s))) for n, s in found.items()], "node binary, shingles binary, weights binary, total double")
    return members, sets


def brute_components(found):
    label = {n: n for n in found}
    for a in found:
        for b in found:
            if len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b]):
                x, y = label[a], label[b]
                label = {n: min(x, y) if v in (x, y) else v for n, v in label.items()}
    return label


def test_link_between_nodes_of_different_leaders(spark):
    # x is like a, y is like the b's, and only x and y join the two groups
    found = {b"a": set(range(100)), b"a2": set(range(99)), b"x": set(range(10, 110)), b"y": set(range(20, 120)), b"b": set(range(30, 130))}
    found |= {f"b{k:02d}".encode(): found[b"b"] - {60 + k} for k in range(24)}
    labels = neardup.components(neardup.links(*bucket_of(spark, found)))
    assert {bytes(r.label) for r in labels.collect()} == {b"a"} and labels.count() == len(found)


@pytest.mark.parametrize("weight", [400_000, 600])
def test_links_join_what_brute_force_joins(spark, monkeypatch, weight):
    monkeypatch.setattr(neardup, "BLOCK_WEIGHT", weight)
    rng, found = random.Random(8), {}
    for k in range(90):
        at = rng.randrange(150)
        found[f"n{k:02d}".encode()] = set(range(at, at + 100)) - set(rng.sample(range(at, at + 100), 3))
    want = brute_components(found)
    label = {n: n for n in found} | {bytes(r.node): bytes(r.label) for r in neardup.components(neardup.links(*bucket_of(spark, found))).collect()}
    assert label == want


def test_unlike_texts_of_null_or_equal_ids_stay(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (7, text(2)), (7, text(3)), (8, text(3)), (None, "..."), (None, "?!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in neardup.keep_one(df).collect())
    assert kept == sorted([(-1, text(0)), (-1, text(1)), (7, text(2)), (7, text(3)), (-1, "..."), (-1, "?!")])
    got = neardup.classes(df).collect()
    assert sorted(r.class_size for r in got) == [1, 1, 1, 1, 2, 2, 2, 2]
    assert len({(r.class_id, r.class_th) for r in got}) == 6


def test_sampling_follows_weighted_jaccard():
    rng = np.random.default_rng(1)
    s = np.sort(rng.integers(0, 2**48, 400, dtype=np.uint64))
    w = rng.choice(np.array([0.5, 1, 2, 3], np.float32), 400)
    v = np.where(rng.random(400) < 0.5, w, rng.choice(np.array([0.5, 1, 2, 3], np.float32), 400)).astype(np.float32)
    sampler = neardup.Sampler()
    same = []
    for seed in range(12):
        rolled = s ^ np.uint64(seed * 0x9E3779B1)
        k = sampler.sketch(np.concatenate([rolled, rolled]), np.concatenate([w, v]), np.array([0, 400]))
        same.append((k[0] == k[1]).mean())
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    assert np.mean(same) == pytest.approx(want, abs=0.06)
    assert neardup.similarity((s.tobytes(), w.tobytes()), (s.tobytes(), v.tobytes())) == pytest.approx(want, abs=1e-5)


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    rows = []
    for k in range(400):
        words = [word() for _ in range(rng.randrange(20, 200))]
        kind = k % 8
        text = " | ".join(words) if kind == 0 else "!! ".join(w.upper() for w in words) if kind == 1 else ". ".join(" ".join(words[j : j + 9]).capitalize() for j in range(0, len(words), 9)) + "."
        rows.append((k, text, int(kind > 1)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {i: q for i, _, q in rows}


def test_quality_on_held_out_rows(spark, graded):
    docs, labels, truth = graded
    extra = spark.createDataFrame([(9000, None, None, None, None), (9001, "", None, None, None), (9002, "x" * 200_000, None, None, None), (None, "text", None, None, None)], docs.schema)
    got = quality.classify(docs.unionByName(extra), labels.unionByName(labels.limit(3))).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_are_not_used(spark, graded):
    docs, labels, _ = graded
    turned = labels.withColumn("quality", F.when(quality.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_without_labels_everything_is_neutral(graded):
    docs, labels, _ = graded
    assert {r.score for r in quality.classify(docs, labels.where("doc_id < 0")).collect()} == {0.5}


def test_pipeline(spark, graded, tmp_path):
    docs, labels, truth = graded
    copies = docs.where("doc_id in (2, 3, 4)").withColumn("doc_id", F.col("doc_id") + 5000)
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "packing"]
    kept = docs.unionByName(copies)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {5002, 5003, 5004} and {2, 3, 4} <= ids
    good = {i for i, q in truth.items() if q}
    assert len(ids & good) > 0.97 * len(good) and len(ids - good) < 5
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def naive_score(model, text):
    """The vote, neighbour by neighbour."""
    tf = quality.counts([text])[0].astype(float)
    w = np.log1p(tf) * model.idf
    w = w / max(np.sqrt((w * w).sum()), 1e-9)
    v = np.array([(w * model.basis[:, k]).sum() for k in range(model.basis.shape[1])])
    v = v / max(np.sqrt((v * v).sum()), 1e-9)
    near = sorted(((float((v * u).sum()), float(y)) for u, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
    weight = [max(c, 0) ** quality.POWER for c, _ in near]
    votes = sum(a * y for a, (_, y) in zip(weight, near, strict=True))
    return (votes + 0.05 * model.share) / (sum(weight) + 0.05)


def test_votes_equal_brute_force(spark, graded):
    docs, labels, _ = graded
    model = quality.train(docs, labels)
    some = docs.where("doc_id % 7 = 0")
    want = {r.doc_id: naive_score(model, r.text) for r in some.collect()}
    got = {r.doc_id: r.score for r in quality.scored(some, model, name="score").collect()}
    assert got == pytest.approx(want, abs=2e-4)


def test_one_repeated_id_does_not_fill_the_fit(spark, graded):
    docs, labels, _ = graded
    first = docs.where("doc_id = 1")
    many = docs.unionByName(first.crossJoin(spark.range(3000)).drop("id"))
    known = labels.where(quality.fold("doc_id") != 0).count()
    assert len(quality.train(many, labels).labels) == known
    assert len(quality.train(many, labels, fit_rows=20).labels) == 20


def test_the_driver_gets_the_model_of_the_fit_not_its_rows(spark, graded, monkeypatch):
    docs, labels, _ = graded
    got = []
    for name in ("collect", "toArrow", "toPandas"):

        def noted(self, *args, plain=getattr(type(docs), name)):
            out = plain(self, *args)
            got.append(out.nbytes if hasattr(out, "nbytes") else len(str(out)))
            return out

        monkeypatch.setattr(type(docs), name, noted)
    model = quality.train(docs, labels)
    parts = (model.idf, model.basis, model.vectors, model.labels)
    # an escaped byte has up to four characters
    assert len(model.labels) > 100 and 0 < sum(got) < 4 * sum(x.nbytes for x in parts) + 10_000
    assert sum(x.nbytes for x in parts) < 4 * quality.TERMS * len(model.labels) / 4


def test_pipeline_equals_brute_force_on_odd_rows(spark, graded, tmp_path):
    docs, labels, _ = graded
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n)) + "."
    passage = prose(8)  # over 240 bytes
    more = [(None, prose(9)), (5000, None), (5001, ""), (5002, prose(12)), (5002, prose(12)), (5003, prose(4) + passage + prose(5)), (5004, prose(6) + passage + prose(3)), (5005, prose(7000))]
    more += [(6000 + k, more[3][1]) for k in range(3)] + [more[5], more[5]]
    extra = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in more], docs.schema)
    table = docs.unionByName(extra).select("*", F.lit(1).alias("score"), F.lit(2).alias("k1"), F.lit(3).alias("own_th"), F.lit(4).alias("spans"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda rows: sorted((str(r.doc_id), r.text or "") for r in rows)
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, first), (_, second), (_, third), (_, fourth) = corpus_pipeline.STAGES
    model = quality.train(kept, labels)
    rows = kept.collect()
    good = first(spark, kept, str(tmp_path))
    assert good.columns == table.columns
    scores = [naive_score(model, r.text or "") for r in rows]
    assert min(abs(x - quality.KEEP) for x in scores) > 1e-3
    rows = [r for r, x in zip(rows, scores, strict=True) if x >= quality.KEEP]
    assert key(good.collect()) == key(rows)
    weights = neardup.Weights(neardup.document_frequencies(neardup._prepared(good, "doc_id", "text")), len(rows))
    texts = [(k, r.text or "") for k, r in enumerate(rows)]
    named = lambda k: (rows[k].doc_id is None, rows[k].doc_id or 0)
    classes_ = [[int(k) for k in c] for c in brute_classes(texts, weights)]
    single = second(spark, good, str(tmp_path))
    firsts = [min(named(k) for k in c) for c in classes_]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in single.collect()) == sorted(firsts)
    held = single.collect()
    cut = third(spark, single, str(tmp_path))
    assert cut.columns == table.columns
    want = {(i, n, digest) for i, n, *_, digest in brute_repeats([(r.doc_id, r.text) for r in held], corpus_pipeline.PASSAGE)}
    got = {(str(r.doc_id), len((h.text or "").encode()), sha256((r.text or "").encode()).hexdigest()) for r in cut.collect() for h in held if (h.doc_id, (h.text or "")[:20] if r.text else None) == (r.doc_id, (r.text or "")[:20] if r.text else None) or (h.doc_id == r.doc_id and not r.text)}
    assert got == want and any(r.n_chars is not None and r.text is not None and r.n_chars != len(r.text) for r in cut.collect()) is False
    packed = fourth(spark, cut, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in held}
    none = kept.where("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0
