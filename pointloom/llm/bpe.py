"""Byte-level BPE: encoding by a pair occurrence index, decoding by vocabulary bytes.

A vocabulary file (the ``tokenizers`` JSON format) is read once on the driver, a few
MB at any corpus size, and travels to the tasks as a broadcast value. Each distinct word
of a task's texts is merged once, in an index from pairs to all their positions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: The splitting pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words a worker remembers before it starts afresh; bounds its memory.
MEMORY = 500_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 byte values: printable Latin-1 stands for itself,
    every other byte for the next free code point from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks and token bytes of a byte-level BPE file."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        ids, alphabet = j["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in ids.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        #: by rank: the id that the merge makes
        self.news = np.array([ids[x + y] for x, y in merges] + [-1], dtype=np.int64)
        #: by rank: the ids that it merges
        self.left, self.right = ([ids[m[k]] for m in merges] for k in (0, 1))
        packed = np.array([ids[x] << 20 | ids[y] for x, y in merges], dtype=np.int64)
        self._order = np.argsort(packed, kind="stable")
        self._pairs = np.append(packed[self._order], np.int64(1) << 62)
        self._order = np.append(self._order, NEVER)
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None


    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NEVER`` where the pair doesn't merge."""
        pair = left << 20 | right
        at = np.searchsorted(self._pairs, pair)
        return np.where(self._pairs[at] == pair, self._order[at], NEVER)


#: Above every rank; the symbol between words and of a place that was merged away.
NEVER, END = 1 << 30, (1 << 20) - 1


class PairIndex:
    """The positions of every pair that can merge, over all words of a partition's batch.

    ``sym`` has the words one after the other, END between them; ``after`` and ``before``
    link the symbols that are left. A pair is named by its rank. Its positions are one slice
    of the first sort and the lists that merges have added since; ``active`` is a heap of the
    ranks that have any. An entry whose symbols have changed meanwhile is passed over when
    its rank's turn comes."""

    def __init__(self, vocab: Vocabulary, sym: np.ndarray):
        self.vocab, self.sym = vocab, sym
        n = len(sym)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = vocab.ranks(sym[:-1], sym[1:])
        spots = np.flatnonzero(rank != NEVER)
        rank = rank[spots]
        order = np.argsort(rank, kind="stable")
        self.spots, rank = spots[order], rank[order]
        first = np.flatnonzero(np.diff(rank, prepend=-1))
        names = rank[first].tolist()
        bounds = [*first.tolist(), len(rank)]
        self.slices = dict(zip(names, pairwise(bounds), strict=True))
        self.added: dict[int, list[np.ndarray]] = {}
        self.active = names  # ascending, so a heap

    def positions(self, rank: int) -> np.ndarray:
        """The pair's positions, ascending, as they stand."""
        lists = self.added.pop(rank, [])
        if rank in self.slices:
            a, b = self.slices.pop(rank)
            lists.append(self.spots[a:b])
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        left, right = self.vocab.left[rank], self.vocab.right[rank]
        at = at[self.sym[at] == left]
        at = at[self.sym[self.after[at]] == right]
        if left == right and len(at) > 1:
            # of overlapping places (a run of one symbol) every second goes, from the left
            run = np.flatnonzero(np.append(True, self.after[at[:-1]] != at[1:]))
            within = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[within % 2 == 0]
        return at

    def add(self, at: np.ndarray) -> None:
        """List the pairs that now begin at the places ``at``."""
        rank = self.vocab.ranks(self.sym[at], self.sym[self.after[at]])
        some = rank != NEVER
        at, rank = at[some], rank[some]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.diff(rank, prepend=-1))
        for name, places in zip(rank[first].tolist(), np.split(at, first[1:]), strict=True):
            if name in self.added:
                self.added[name].append(places)
            else:
                self.added[name] = [places]
                if name not in self.slices:
                    heappush(self.active, name)

    def merge(self) -> None:
        """Apply all active ranks in ascending order. A merge makes pairs of higher ranks
        only (its result is a part of them), so every word sees its own order of merges."""
        sym, after, before = self.sym, self.after, self.before
        while self.active:
            rank = heappop(self.active)
            at = self.positions(rank)
            if not len(at):
                continue
            gone = after[at]
            follows = after[gone]
            sym[at], sym[gone] = self.vocab.news[rank], END
            after[at], before[follows] = follows, at
            near = before[at]
            self.add(np.unique(np.concatenate([near[near >= 0], at])))


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each word), by one
    :class:`PairIndex` over all words."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    sym = np.full(len(data) + len(words) + 1, END, dtype=np.int64)
    inside = np.ones(len(sym), dtype=bool)
    inside[ends] = inside[-1] = False
    sym[inside] = np.array(vocab.of_byte, dtype=np.int64)[data]
    PairIndex(vocab, sym).merge()
    left = np.concatenate([[0], np.cumsum(sym != END)])
    bounds = left[np.concatenate([[0], ends + 1])]
    return sym[sym != END], np.diff(bounds)


class IndexedEncoder:
    """Encodes batches of texts; remembers each distinct word's ids as text and as bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.words = vocab, {}
        self.text_of = {i: f"{i}," for i in vocab.bytes_of}

    def _split(self, text: str) -> list[str]:
        if not self.vocab.specials or not self.vocab.specials.search(text):
            return self.vocab.pattern.findall(text)
        at, out = 0, []
        for m in self.vocab.specials.finditer(text):
            out += [*self.vocab.pattern.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.vocab.pattern.findall(text[at:])

    def batch(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, each in decimal and followed by a comma, and the bytes
        that they decode to."""
        split = [self._split(t) for t in texts]
        fresh: set[str] = set()
        for words in split:
            fresh.update(words)
        if len(self.words) > MEMORY:
            self.words.clear()
        fresh.difference_update(self.words)
        for special in fresh & self.vocab.special.keys():
            self._learn(special, [self.vocab.special[special]])
            fresh.discard(special)
        if fresh:
            order = list(fresh)
            ids, counts = merge_words(self.vocab, [w.encode() for w in order])
            ids, at = ids.tolist(), 0
            for w, n in zip(order, counts.tolist(), strict=True):
                self._learn(w, ids[at : at + n])
                at += n
        for words in split:
            found = [self.words[w] for w in words]
            yield "".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def _learn(self, word: str, ids: list[int]) -> None:
        self.words[word] = ("".join([self.text_of[i] for i in ids]), b"".join([self.vocab.bytes_of[i] for i in ids]))


def round_trip(docs: DataFrame, vocab_spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded text.

    One row per input row: a null or empty text has no tokens. Repeated rows give
    repeated results, other columns are ignored, an empty table gives no rows."""
    spec = docs.sparkSession.sparkContext.broadcast(vocab_spec)
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.per_worker("bpe", spec.value, lambda s: IndexedEncoder(Vocabulary(s)))
        for batch in common.in_batches(batches, 2000):
            out: list[list] = [[], [], []]
            for ids, data in encoder.batch(batch.column(1).to_pylist()):
                out[0].append(ids.count(","))
                out[1].append(sha256(ids[:-1].encode()).hexdigest())
                out[2].append(sha256(data.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(docs[id_col].cast("long").alias(id_col), common.whole(docs[text_col]).alias("text"))
    return common.spread(picked).mapInArrow(run, schema)


def encode(docs: DataFrame, vocab_spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, by the same index."""
    spec = docs.sparkSession.sparkContext.broadcast(vocab_spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.per_worker("bpe", spec.value, lambda s: IndexedEncoder(Vocabulary(s)))
        for batch in common.in_batches(batches, 2000):
            ids = [[int(i) for i in found[:-1].split(",")] if found else [] for found, _ in encoder.batch(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    picked = docs.select(docs[id_col].cast("long").alias(id_col), common.whole(docs[text_col]).alias("text"))
    return common.spread(picked).mapInArrow(run, f"{id_col} long, ids array<int>")


def decode(encoded: DataFrame, vocab_spec: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of id lists; invalid UTF-8 becomes U+FFFD, special tokens stay, a null
    list gives an empty text and unknown ids are skipped."""
    spec = encoded.sparkSession.sparkContext.broadcast(vocab_spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Vocabulary(spec.value).bytes_of
        for batch in batches:
            texts = [b"".join([of.get(i, b"") for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(encoded[id_col].cast("long").alias(id_col), encoded[ids_col].alias("ids")).mapInArrow(run, f"{id_col} long, text string")
