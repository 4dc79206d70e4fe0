"""Files of token ids: blocks, files, encoding by words, whole round trips."""

import random
import struct
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointloom.llm import queries, tokens

SPEC = queries.vocabulary("word_bpe_49k.json")
KEPT = tokens.text_encoder(SPEC, 1)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(SPEC)
    t.no_truncation()
    t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=3000), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(values, share):
    ids = np.array(values, np.uint32)
    blocks = tokens.packed_blocks(ids, share)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    assert tokens.unpacked_blocks(b"".join(blocks), starts)[: len(ids)].tolist() == values


def test_outliers_are_exceptions():
    """A block of small values with two large ones keeps the small values' width."""
    ids = np.array([7 + k % 8 for k in range(1022)] + [2**32 - 1, 2**31], np.uint32)
    (block,) = tokens.packed_blocks(ids)
    low, width, _, exceptions = struct.unpack_from(tokens._HEAD, block)
    assert (low, width, exceptions) == (7, 3, 2)
    assert len(block) == 8 + 1024 * 3 // 8 + 2 * (2 + 4)


TEXTS = ["", "Hello,  World!", "don't we'll 's 'S x's", "ÀÉÎ straße ŒUVRE İstanbul ΣΑΣ", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "éa H̱ ≠ e≠ Å", "tab\tnl\nff\x0cvt\x0bnbsp\xa0nel\x85sep x\x1cy", "***a.b,c;d!?e(f)[g]{h}<i>|j'k\"", "数字１２３ ½ ² ٣ 日本語テスト", "🙂👍🏽 a🙂b", "x" * 5000, " lead and trail ", "́start", "A.́", "ŉ ǆ ﬁ ﬀ"]


def test_words_equal_the_library(library):
    encode = tokens.WordEncoder(SPEC, 1)
    rng = random.Random(3)
    signs = "abcdeABCDE éÉßñ\t\n.,;:!?'’-_()<>|=*#́̈\x1c\x85\xa0１²Σσςİ🙂"
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for part in (texts, texts[:1], texts[100:400], [""]):
        counts, ids = encode(pa.array(part))
        want = [library(t) for t in part]
        assert counts == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_any_text_equals_the_library(library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    counts, ids = KEPT(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in library(t)] and sum(counts) == len(ids)


def test_forgotten_words_are_learned_again(library, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 3)
    encode = tokens.WordEncoder(SPEC, 1)
    for text in ("one two three four five", "two six", "one two"):
        assert encode(pa.array([text]))[1].tolist() == library(text)


def test_other_vocabularies_go_to_the_library():
    spec = queries.vocabulary()
    t = Tokenizer.from_str(spec)
    counts, ids = tokens.text_encoder(spec, 1)(pa.array(["Hello, World!", ""]))
    assert ids.tolist() == [*t.encode("Hello, World!").ids, 1, 1] and counts[1] == 1


def want(rows, library):
    """Brute force: sorted by id (null first), ids one after another."""
    out, start = [], 0
    for i, ids in rows:
        out.append((i, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, library):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["Alpha", "beta,", "gamma's", "7", "é"]) for _ in range(rng.randrange(400)))) for k in rng.sample(range(10**6), 300)]
    rows += [(-5, None), (-4, ""), (None, "no id"), (10**12, " ".join(rng.choice(["one", "two", "three."]) for _ in range(300_000))), (10**12 + 1, "after the long one")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, id_ int, text_ string, place_ int").repartition(5)
    got = [tuple(r) for r in tokens.round_trip(df, SPEC).orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    assert got == want([(i, library(t)) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))], library)
    assert tokens.round_trip(df.limit(0), SPEC).collect() == []


def test_repeated_ids_and_rows(spark, library):
    rows = [(5, "same row")] * 40 + [(5, "other text"), (6, "end"), (None, None), (None, None)]
    got = sorted((tuple(r) for r in tokens.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), SPEC).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 2 + [5] * 41 + [6]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert sorted(r[3] for r in got) == sorted(crc32(np.array(library(t), "<u4").tobytes()) for _, t in rows)


def test_known_ids(spark, tmp_path):
    rows = [(3, [1, 2, 3]), (1, []), (2, [2**32 - 1, 0] * 700), (4, None)]
    tokens.write_ids(spark.createDataFrame(rows, "doc_id long, ids array<long>"), f"file://{tmp_path}/ids")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids) for r in tokens.read(spark, f"file://{tmp_path}/ids").orderBy("start", "n_tokens").collect()]
    assert got == [(1, 0, 0, []), (2, 0, 1400, [2**32 - 1, 0] * 700), (3, 1400, 3, [1, 2, 3]), (4, 1403, 0, [])]


def test_slices_and_parts(spark, tmp_path, monkeypatch):
    """Files of many slices, documents that cross blocks, slices and parts."""
    monkeypatch.setattr(tokens, "SLICE", 5000)
    monkeypatch.setattr(tokens, "AT_ONCE", 2048)
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(0, 50_000, int(n)).tolist()) for k, n in enumerate(rng.choice([0, 1, 3, 900, 1024, 2048, 2049, 20_000], 60))]
    tokens.write_ids(spark.createDataFrame(rows, "doc_id long, ids array<long>").repartition(3), f"{tmp_path}/ids")
    assert [(r.doc_id, r.ids) for r in tokens.read(spark, f"{tmp_path}/ids").orderBy("doc_id").collect()] == rows
    assert [tuple(r) for r in tokens.read(spark, f"{tmp_path}/ids", digests=True).orderBy("doc_id").collect()] == want(rows, None)


def test_query(spark, library):
    got = queries.queries()["op12_patched_token_files"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want([(r.doc_id, library(r.text)) for r in docs], library)
