"""Cost-balanced sequence packing.

Attention costs a linear plus a quadratic share of each piece's length. Documents are
taken in descending length and each goes to the cheapest sequence that still has room;
only a document that fits nowhere is cut. Packing needs no shuffle: each scan partition
packs its own documents in blocks of bounded size, and a block wastes less than one
sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe, common

#: Ids or documents after which a block is packed: bounds a task's memory.
BLOCK_IDS, BLOCK_DOCS = 4_000_000, 8192


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) of documents of the given lengths.

    Whole multiples of ``capacity`` fill sequences of their own. The remainders share
    as few sequences as their sum needs, in descending length (ties: the earlier
    document), each in the sequence of the lowest cost that has room (ties: the lowest
    number). Where none has room, the roomiest sequences take one part each."""
    out, full, rest = [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, full))
            full += 1
        if n % capacity:
            rest.append((n % capacity, d))
    rest.sort(key=lambda x: (-x[0], x[1]))
    bins = -(-sum(n for n, _ in rest) // capacity)
    room, cost = np.full(bins, capacity, dtype=np.int64), np.zeros(bins)
    for n, d in rest:
        start = lengths[d] - n
        while n:
            fits = np.where(room >= n, cost, np.inf)
            k = int(fits.argmin())
            part = n
            if fits[k] == np.inf:
                k = int(room.argmax())
                part = int(room[k])
            out.append((d, start, part, full + k))
            room[k] -= part
            cost[k] += linear * part + quadratic * part * part
            start, n = start + part, n - part
    return out


def follows_merges(spec: str) -> bool:
    """Whether byte ranks say the same as the file's merges: ids ascend in merge order after
    those of single bytes, and the bytes of every entry merge to that entry alone."""
    vocab = bpe.Vocabulary(spec)
    made = vocab.news[:-1]
    if not len(made) or max(vocab.of_byte) >= made[0] or (np.diff(made) <= 0).any():
        return False
    entries = {i: t for i, t in vocab.bytes_of.items() if i not in vocab.special.values()}
    ids, counts = bpe.merge_words(vocab, list(entries.values()))
    return bool((counts == 1).all()) and ids.tolist() == list(entries)


def encoder(spec: str, ranked: bool | None = None) -> Callable[[str], bytes]:
    """Text to little-endian 32-bit ids, as ``tokenizers`` gives them for this file.

    Where the file passes :func:`follows_merges` (``ranked``: already known), the same
    merges run faster as byte ranks in tiktoken; other vocabularies, texts that spell out a
    special token, and texts that tiktoken refuses (its pattern matcher gives up on very
    long white space), go to tokenizers."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(spec)
    slow.no_truncation()
    slow.no_padding()
    vocab = bpe.Vocabulary(spec)

    def exact(text: str) -> bytes:
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    if follows_merges(spec) if ranked is None else ranked:
        import tiktoken

        ranks = {t: i for i, t in vocab.bytes_of.items() if i not in vocab.special.values()}
        fast = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def quick(text: str) -> bytes:
            if any(s in text for s in vocab.special):
                return exact(text)
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:
                return exact(text)

        return quick
    return exact


def pack(docs: DataFrame, vocab_spec: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts (plus ``end_id``) and pack them; one row per piece.

    A null or empty text is the end id alone. Repeated rows are packed as documents of
    their own. Sequence numbers are unique across tasks; offsets in a sequence have no
    gaps. ``with_ids`` adds the piece's ids; other columns are ignored."""
    spec = docs.sparkSession.sparkContext.broadcast(vocab_spec)
    ranked = common.per_worker("ranked", vocab_spec, follows_merges)
    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def block(ids: list, tokens: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(t) // 4 for t in tokens]
        placed = assign(lengths, capacity)
        taken = [0] * (max(s for *_, s in placed) + 1)
        cols: list[list] = [[] for _ in range(8)]
        for d, start, n, s in placed:
            piece = tokens[d][4 * start : 4 * (start + n)]
            for c, v in zip(cols, (ids[d], start, n, crc32(piece), lengths[d], base + s, taken[s], piece), strict=True):
                c.append(v)
            taken[s] += n
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())] * with_ids
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)]), len(taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = common.per_worker("packing", spec.value, lambda s: encoder(s, ranked))
        end = np.array([end_id], "<u4").tobytes()

        base, ids, tokens, size = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in common.in_batches(batches, 2000):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                tokens.append(encode(text) + end)
                size += len(tokens[-1]) // 4
                if size >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                    out, n = block(ids, tokens, base)
                    yield out
                    base, ids, tokens, size = base + n, [], [], 0
        if ids:
            yield block(ids, tokens, base)[0]

    picked = docs.select(docs[id_col].cast("long").alias(id_col), common.whole(docs[text_col]).alias("text"))
    return common.spread(picked).mapInArrow(run, schema)
