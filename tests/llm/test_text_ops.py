"""Tokenization, packing, fingerprints, media: exact round trips and brute force."""

import re
import time
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pointloom.llm import bpe, fingerprint, media, packing, queries

SCHEMA = "doc_id long, text string, score_ double, k1 long, th long, id long"
TEXTS = [
    (5, "The quick brown fox, isn't it? 123  456\n\n\tnew  line ", None, 1, 2, 3),
    (1, None, 0.1, None, None, None),
    (2, "", None, 1, 2, 3),
    (3, "aaaaaaaaaaaa aaa a", 0.5, 1, 2, 3),
    (4, "naïve café über ñandú 漢字 🙂🙂 \u2028 x", None, 1, 2, 3),
    (9, "before<|endoftext|> after  <|endoftext|>", None, 1, 2, 3),
    (7, "word " * 3000, None, 1, 2, 3),
    (8, " ".join(f"w{k}" for k in range(2500)), None, 1, 2, 3),
    (8, " ".join(f"w{k}" for k in range(2500)), None, 1, 2, 3),
    (None, "no id", None, 1, 2, 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(docs, tokenizer):
    want = sorted((str(r[0]), (e := tokenizer.encode(r[1] or "", add_special_tokens=False).ids) and len(e), sha256(",".join(map(str, e)).encode()).hexdigest(), sha256(tokenizer.decode(e, skip_special_tokens=False).encode()).hexdigest()) for r in TEXTS)
    got = sorted((str(r.doc_id), r.n_tokens or [], r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, queries.vocabulary()).collect())
    assert got == want


def test_encode_then_decode(docs, tokenizer):
    held = bpe.encode(docs, queries.vocabulary())
    ids = {r.doc_id: r.ids for r in held.collect()}
    assert ids[4] == tokenizer.encode(TEXTS[4][1], add_special_tokens=False).ids
    assert {r.doc_id: r.text for r in bpe.decode(held, queries.vocabulary()).collect()}[4] == TEXTS[4][1]


def test_pair_index_on_runs():
    vocab = bpe.Vocabulary(queries.vocabulary())
    words = [b"a" * n for n in range(1, 40)] + [b"abababab", b" the", b"\xff\xfe"]
    ids, counts = bpe.merge_words(vocab, words)
    assert counts.sum() == len(ids)
    at = np.split(ids, np.cumsum(counts)[:-1])
    assert [b"".join(vocab.bytes_of[i] for i in w) for w in at] == words
    assert bpe.merge_words(vocab, [])[0].tolist() == []


def test_random_strings_encode_as_in_the_library(tokenizer):
    rng = np.random.default_rng(6)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "🙂", "'s", "'LL", "1", "23", "the", "ing", "<|endoftext|>", ".", "!!", "\u2003", "Ti", "tion", "\x00", "_", "ſ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(2000)]
    texts += ["".join(chr(c) for c in rng.integers(1, 0x2FFF, 30)) for _ in range(500)]
    spec = queries.vocabulary()
    assert packing.follows_merges(spec)
    index, packed = bpe.IndexedEncoder(bpe.Vocabulary(spec)), packing.encoder(spec)
    for t, (ids, data) in zip(texts, index.batch(texts), strict=True):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert [int(i) for i in ids[:-1].split(",") if i] == want
        assert packed(t) == np.array(want, "<u4").tobytes() and data.decode() == t


def test_pair_index_equals_greedy_merges():
    vocab = bpe.Vocabulary(queries.vocabulary())
    pairs = {(a, b): k for k, (a, b) in enumerate(zip(vocab.left, vocab.right, strict=True))}

    def greedy(word):
        sym = [vocab.of_byte[c] for c in word]
        while found := [(pairs[p], k) for k, p in enumerate(zip(sym, sym[1:], strict=False)) if p in pairs]:
            rank, k = min(found)
            sym[k : k + 2] = [int(vocab.news[rank])]
        return sym

    rng = np.random.default_rng(2)
    words = [bytes(rng.choice(list(b"aabbcdetinos "), rng.integers(1, 40)).astype(np.uint8)) for _ in range(400)]
    ids, counts = bpe.merge_words(vocab, words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [greedy(w) for w in words]


def test_very_long_words_merge_fast(tokenizer):
    vocab = bpe.Vocabulary(queries.vocabulary())
    word = bytes(np.random.default_rng(1).choice(list(b"abcdefghijklmnopqrstuvwxyz"), 80_000).astype(np.uint8))
    began = time.perf_counter()
    ids, _ = bpe.merge_words(vocab, [word])
    assert time.perf_counter() - began < 1  # 0.06 s alone; one sweep a merge takes over 1 s
    assert ids.tolist() == tokenizer.encode(word.decode(), add_special_tokens=False).ids


def check_packing(rows, tokens, capacity):
    held, places = {}, {}
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in held.items():
        end = 0
        for start, n, crc, total in sorted(pieces):
            assert start == end and total == len(tokens[i]) and crc == zlib.crc32(tokens[i][start : start + n].tobytes())
            end = start + n
        assert end == len(tokens[i])
    for spots in places.values():
        end = 0
        for offset, n in sorted(spots):
            assert offset == end
            end += n
        assert end <= capacity
    return len(places)


def test_packing_is_exact(spark, tokenizer):
    rows = [(k, "tok " * (k * 37 % 900)) for k in range(120)] + [(500, None), (501, "x " * 9000)]
    tokens = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = packing.pack(df, queries.vocabulary()).collect()
    total = sum(map(len, tokens.values()))
    assert check_packing(out, tokens, 2048) <= total / 2048 + 8  # at most one short sequence a task
    assert packing.pack(df.where("doc_id < 0"), queries.vocabulary()).count() == 0


def test_very_long_white_space_is_encoded(tokenizer):
    encode = packing.encoder(queries.vocabulary())
    for text in ("a" + " " * 1_200_000 + "b", "\n" * 1_200_000, "a b" * 10):
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_assignment_balances_cost():
    lengths = [900, 700, 600, 500, 400, 300, 200, 100, 50]
    placed = packing.assign(lengths, 2048)
    bins = -(-sum(lengths) // 2048)
    assert {s for *_, s in placed} == set(range(bins))
    cost = [sum(n + n * n / 2048 for *_, n, s in placed if s == b) for b in range(bins)]
    assert max(cost) < 1.35 * min(cost)
    assert packing.assign([5000], 2048) == [(0, 0, 2048, 0), (0, 2048, 2048, 1), (0, 4096, 904, 2)]
    assert packing.assign([2048], 2048) == [(0, 0, 2048, 0)]


def test_fingerprints(spark):
    words = [f"term{k}" for k in range(60)]
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(words, 30)), 1, 2) for k in range(40)] + [(40, None, 1, 2), (41, "", 1, 2), (42, "!!!", 1, 2), (100, "same text here term1", 1, 2), (101, "same text here term1", 1, 2), (None, "lost", 1, 2), (7, "a second row of seven", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, own int")
    got = fingerprint.fingerprints(df).collect()
    assert len(got) == len(rows)
    order = sorted(((-1 if i is None else i), t or "") for i, t, *_ in rows)
    single = {i: n for n, (i, _) in enumerate(order) if sum(i == j for j, _ in order) == 1}
    for r in got:
        i = -1 if r.doc_id is None else r.doc_id
        if i not in single or i in (6, 101, -1):
            continue
        text, after = order[single[i]][1], order[(single[i] + 1) % len(order)][1]
        n, h = len(text), len(text) // 2
        assert r.n_chars == n and r.edited_sha256 == sha256((text[: n - h] + after[:h]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in got}
    assert by[100].fingerprint == by[101].fingerprint and by[100].near_next == 1
    assert by[40].fingerprint == by[41].fingerprint != by[42].fingerprint
    assert fingerprint.fingerprints(df.where("doc_id = 3")).count() == 1


def brute_fingerprint(text, masks):
    """Subset hashes of one text by definition, over the lexicon's {term: mask}."""
    found = sorted({t for t in re.findall("[a-z0-9]+", text.lower()) if t in masks})
    return [tuple(t for t in found if masks[t] >> k & 1) or None for k in range(fingerprint.SUBSETS)]


def brute_likeness(a, b):
    best = 0.0
    for v in range(len(fingerprint.RATES)):
        level = range(v * fingerprint.EACH, (v + 1) * fingerprint.EACH)
        used = sum(a[k] is not None or b[k] is not None for k in level)
        same = sum(a[k] is not None and a[k] == b[k] for k in level)
        best = max(best, same / max(used, fingerprint.FEWEST))
    return best


def test_fingerprints_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"term{k}" for k in range(80)]
    rows = [(3 * k, " ".join(rng.choice(words, rng.integers(20, 50)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.h: r.w for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    lex = fingerprint.lexicon(df, len(rows)).collect()
    share = {w: sum(w in t.split() for _, t in rows) / len(rows) for w in words}
    masks = {hashes[r.term]: r.mask for r in lex if r.term in hashes}
    assert set(masks) == {w for w, p in share.items() if fingerprint.LEAST <= p <= fingerprint.MOST}
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]
    own, cut = ([brute_fingerprint(t, masks) for t in ts] for ts in (texts, edited))
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    printed = {}
    for k, (i, _) in enumerate(rows):
        r = got[i]
        assert r.near_edited == pytest.approx(brute_likeness(own[k], cut[k]))
        assert r.near_next == pytest.approx(brute_likeness(own[k], own[(k + 1) % len(own)]))
        for n, (part, sub) in enumerate(zip(r.fingerprint.split("."), own[k], strict=True)):
            assert (part == "-") == (sub is None) and printed.setdefault((n, sub), part) == part
    assert np.mean([r.near_edited for r in got.values()]) > 1.3 * np.mean([r.near_next for r in got.values()])


def test_far_and_repeated_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "LEVEL", 8)
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 40)
    rows = [(k, f"text {k}") for k in range(600)] + [(2**62, "far"), (-(2**62), "low")] + [(300, f"same id {k}") for k in range(1500)] + [(None, f"none {k}") for k in range(90)] + [(700, "equal")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = fingerprint.with_next(df).where("guest = 0").collect()
    assert len(held) == len(rows)
    sizes = Counter(r.part for r in held)
    assert len(sizes) > 40 and max(sizes.values()) < 160
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    order = [t for _, _, t in sorted((-(2**63) if i is None else i, hashes[t], t) for i, t in rows)]
    follows = Counter(zip(order, order[1:], strict=False))
    assert Counter((r.text, r.next_text) for r in held if r.next_text is not None) - follows in (Counter(), Counter([(order[-1], order[0])]))
    assert all(r.next_text is not None for r in held)


def test_near_copies_in_the_largest_group_and_of_rare_terms(spark):
    rng = np.random.default_rng(4)
    text = lambda name, k: " ".join([*(f"{name}{j}" for j in range(60)), f"only{name}{k}"])
    third = [(k, text("g", k)) for k in range(40)] + [(100 + k, " ".join(f"w{j}" for j in rng.integers(0, 300, 60))) for k in range(80)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(third, "doc_id long, text string")).collect()}
    assert all(got[k].near_next > 0.5 for k in range(39)) and got[39].near_next < 0.5
    rare = [(k, text("r", k)) for k in range(2)] + [(10, text("q", 0))] + [(100 + k, "filler") for k in range(2000)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rare, "doc_id long, text string")).collect()}
    assert got[0].near_next > 0.5 and got[1].near_next < 0.5 and got[0].fingerprint != got[1].fingerprint


def test_empty_tables(spark, docs):
    none = docs.where("doc_id = -5")
    assert bpe.round_trip(none, queries.vocabulary()).count() == 0
    assert media.text_media(none).count() == 0
    assert fingerprint.fingerprints(none).count() == 0


def test_media_round_trip(docs):
    got = media.text_media(docs).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    for i, text, *_ in TEXTS:
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert by[1].feature == by[2].feature and by[1].media_sha256 == by[2].media_sha256


def test_png_filters():
    rows = np.arange(48, dtype=np.uint8).reshape(2, 24)
    assert (media.from_png(media.to_png(rows.tobytes())) == rows).all()
    with pytest.raises(ValueError):
        media.from_png(b"GIF89a")


def test_interleaving_keeps_positions_and_captions():
    page = '<h1>A &amp; b</h1><figure><img src="sha256:aa" alt="x"><figcaption>First <b>one</b></figcaption></figure><p>mid<img src="u" alt="q">dle</p><!-- <img src="no"> --><script>"<img src=no>"</script>end'
    assert [(x["position"], x["kind"], x["text"] or x["media"], x["caption"]) for x in media.interleaved(page)] == [(0, "text", "A & b", None), (1, "media", "sha256:aa", "First one"), (2, "text", "mid", None), (3, "media", "u", "q"), (4, "text", "dle", None), (5, "text", "end", None)]
    assert media.interleaved("") == []


def test_unknown_digests_stay(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:' + "0" * 64 + '">')], "id long, html string")
    known = spark.createDataFrame([("1" * 64, 5)], "digest string, size int")
    r = media.resolve(media.parse(pages, "id", "html"), known, "id").first()
    assert r.position == 0 and r.size is None
