"""Token ids as files of patched frame-of-reference blocks.

A file holds documents one after another. Its ids are cut into blocks of BLOCK; a block
subtracts its least id, packs what is left at the width that a share of its values fits (a
percentile of the block, not its largest value), and lists the others as exceptions: place
and whole difference. Behind the blocks stand the documents (id, number of ids) and the byte
at which each block starts, so a reader opens any run of documents without what lies before.

    8 bytes   MAGIC
    blocks    least id u32, width u8, 0 u8, exceptions u16, BLOCK packed values,
              exceptions' places u16, their differences u32
    table     per document: id i64, ids u64; whether it has an id u8
    index     per block: its first byte u64
    trailer   documents, ids, first byte of the table u64; MAGIC

Tasks write the files next to each other; a file counts only once its row stands in the
manifest, which Spark's own committer writes: a task that is tried again leaves a file that
nobody reads. Folders may lie in any file system that pyarrow opens (local, S3, HDFS ...).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import discard, shared_dir
from . import common

MAGIC = b"PFORIDS1"
#: Ids of a block, and values that are packed into as many words as the width has bits.
BLOCK, LANES = 1024, 64
#: The share of a block's values that its width holds.
SHARE = 0.9
#: Ids that are packed or unpacked at once, and ids after which a reader's next task starts.
AT_ONCE, SLICE = 1 << 19, 1 << 22
#: Files of a folder at most (a range of ids each).
MOST_FILES = 16_384
_HEAD, _TRAILER = "<IBBH", "<QQQ8s"


# Blocks


def _widths(rest: np.ndarray, share: float) -> np.ndarray:
    """The bits that ``share`` of each row's values fit."""
    at = min(rest.shape[1] - 1, max(0, int(np.ceil(share * rest.shape[1])) - 1))
    return np.frexp(np.partition(rest, at, axis=1)[:, at].astype(float))[1].astype(np.uint8)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2^width as rows of little-endian 64-bit words."""
    v = np.ascontiguousarray(values.reshape(-1, LANES).T)
    out = np.zeros((width, v.shape[1]), np.uint64)
    for k in range(LANES):
        word, shift = divmod(k * width, 64)
        out[word] |= v[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`_packed`."""
    w = np.ascontiguousarray(words.reshape(-1, width).T)
    out, mask = np.empty((LANES, w.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for k in range(LANES):
        word, shift = divmod(k * width, 64)
        out[k] = w[word] >> np.uint64(shift)
        if shift + width > 64:
            out[k] |= w[word + 1] << np.uint64(64 - shift)
    out &= mask
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK)


def packed_blocks(ids: np.ndarray, share: float = SHARE) -> list[bytes]:
    """The blocks of unsigned 32-bit ids; the last one is filled up with its last id."""
    if not len(ids):
        return []
    full = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1], ids.dtype)]).reshape(-1, BLOCK).astype(np.uint64)
    least = full.min(axis=1)
    rest = full - least[:, None]
    width = _widths(rest, share)
    beyond = (rest >> width[:, None].astype(np.uint64)) != 0
    bodies: list[bytes] = [b""] * len(full)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            words = _packed(rest[rows] & np.uint64((1 << w) - 1), w).astype("<u8")
            for n, row in enumerate(rows.tolist()):
                bodies[row] = words[n].tobytes()
    _, place = np.nonzero(beyond)
    value, counts = rest[beyond].astype("<u4"), beyond.sum(axis=1)
    place, ends = place.astype("<u2"), np.cumsum(counts).tolist()
    out = []
    for low, w, n, end, body in zip(least.tolist(), width.tolist(), counts.tolist(), ends, bodies, strict=True):
        out.append(struct.pack(_HEAD, low, w, 0, n) + body + place[end - n : end].tobytes() + value[end - n : end].tobytes())
    return out


def unpacked_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at the given bytes of ``data``."""
    heads = [struct.unpack_from(_HEAD, data, s) for s in starts.tolist()]
    least, width, _, counts = (np.array(c, np.int64) for c in zip(*heads, strict=True)) if heads else (np.zeros(0, np.int64),) * 4
    out = np.empty((len(heads), BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            words = np.stack([np.frombuffer(data, "<u8", BLOCK * w // 64, starts[r] + struct.calcsize(_HEAD)) for r in rows.tolist()])
            out[rows] = _unpacked(words, w)
        else:
            out[rows] = 0
    for row in np.flatnonzero(counts).tolist():
        n, at = int(counts[row]), int(starts[row] + struct.calcsize(_HEAD) + BLOCK * width[row] // 8)
        out[row, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    return (out + least[:, None].astype(np.uint64)).astype(np.uint32).reshape(-1)


# Files


class Writer:
    """One file, written from front to back; holds less than AT_ONCE ids and its tables."""

    def __init__(self, path: str, share: float = SHARE):
        system, self.path = fs.FileSystem.from_uri(path)
        self.share, self.out = share, system.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at, self.ids = len(MAGIC), 0
        self.starts: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, names: list[int | None], counts: list[int], ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and all those ids."""
        self.docs.extend(zip(names, counts, strict=True))
        self.ids += len(ids)
        for k in range(0, len(ids), AT_ONCE):
            self.held.append(ids[k : k + AT_ONCE])
            self.size += len(self.held[-1])
            if self.size >= AT_ONCE:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) - len(ids) % BLOCK
        blocks = packed_blocks(ids[:cut], self.share)
        for b in blocks:
            self.starts.append(self.at)
            self.at += len(b)
        self.out.write(b"".join(blocks))
        self.held, self.size = [ids[cut:]], len(ids) - cut

    def close(self) -> int:
        """Ends the file; its number of bytes."""
        self._flush(True)
        names = np.array([n or 0 for n, _ in self.docs], "<i8").tobytes()
        counts = np.array([n for _, n in self.docs], "<u8").tobytes()
        known = np.array([n is not None for n, _ in self.docs], "u1").tobytes()
        end = names + counts + known + np.array(self.starts, "<u8").tobytes()
        end += struct.pack(_TRAILER, len(self.docs), self.ids, self.at, MAGIC)
        self.out.write(end)
        self.out.close()
        return self.at + len(end)


@dataclass
class Reader:
    """Runs of documents of one file; at most AT_ONCE ids are unpacked at a time."""

    path: str

    def __post_init__(self) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        self.file = system.open_input_file(path)
        size = self.file.size()
        docs, self.ids, table, magic = struct.unpack(_TRAILER, self.file.read_at(struct.calcsize(_TRAILER), size - struct.calcsize(_TRAILER)))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a file of token ids: {self.path}")
        blocks = -(-self.ids // BLOCK)
        rest = self.file.read_at(17 * docs + 8 * blocks, table)
        self.names, self.counts = np.frombuffer(rest, "<i8", docs), np.frombuffer(rest, "<u8", docs, 8 * docs).astype(np.int64)
        self.known = np.frombuffer(rest, "u1", docs, 16 * docs).astype(bool)
        self.starts = np.append(np.frombuffer(rest, "<u8", blocks, 17 * docs), table).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts

    def span(self, low: int, high: int) -> Iterator[np.ndarray]:
        """The ids from ``low`` to before ``high``, in parts."""
        while low < high:
            b0 = low // BLOCK
            b1 = min(-(-high // BLOCK), b0 + AT_ONCE // BLOCK)
            data = self.file.read_at(int(self.starts[b1] - self.starts[b0]), int(self.starts[b0]))
            ids = unpacked_blocks(data, self.starts[b0:b1] - self.starts[b0])
            upto = min(high, b1 * BLOCK)
            yield ids[low - b0 * BLOCK : upto - b0 * BLOCK]
            low = upto

    def documents(self, low: int, high: int) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(id, first id's number, parts of its ids) of the documents that start from ``low``
        to before ``high``; short ones that lie together are read together."""
        k, end = (int(np.searchsorted(self.first, v, "left")) for v in (low, high))
        while k < end:
            upto = max(k + 1, min(end, int(np.searchsorted(self.first + self.counts, self.first[k] + AT_ONCE, "right"))))
            begin, stop = int(self.first[k]), int(self.first[upto - 1] + self.counts[upto - 1])
            whole = np.concatenate([*self.span(begin, stop), np.zeros(0, np.uint32)]) if upto > k + 1 else None
            for d in range(k, upto):
                at, n = int(self.first[d]), int(self.counts[d])
                parts = self.span(at, at + n) if whole is None else iter([whole[at - begin : at - begin + n]])
                yield (int(self.names[d]) if self.known[d] else None), at, parts
            k = upto


# Encoding

# Letters that the vocabulary's normalisation only turns into lower case, and
# signs that end a run of letters whatever follows (an apostrophe may start an ending).
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"!\"#$%&()*+,\-./:;=?@\[\]^_`{}~"
#: Distinct words that a worker remembers at most.
WORDS = 400_000


class WordEncoder:
    """Texts to ids as ``tokenizers`` gives them, for vocabularies that drop white space and
    split runs of letters from signs: each distinct word of the texts goes to the library
    once.

    A text is cut at ASCII white space and between a letter and a sign, where such a
    vocabulary always cuts, so the parts' ids are the text's. Words of plain letters take a
    form of the tokenizer without normaliser and pattern, which do nothing but lower case
    there; it tells the ends of words by their suffix. All others go to the whole tokenizer."""

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer

        held = json.loads(spec)
        self.suffix = held["model"].get("end_of_word_suffix") or ""
        if not self.suffix or held["normalizer"] != _NORMALIZER or held["pre_tokenizer"] != _SPLITTER:
            raise ValueError("not a vocabulary of words")
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        plain = {**held, "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _SPLITTER["pretokenizers"][1]]}}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        vocab = held["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.suffix)]] = True
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        """Word 0 is a document's end."""
        self.words: dict[str, int] = {}
        self.first, self.length, self.flat = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end_id], np.uint32)

    def _learn(self, words: list[str], plain: list[bool]) -> None:
        short = [w for w, p in zip(words, plain, strict=True) if p]
        other = [w for w, p in zip(words, plain, strict=True) if not p]
        lines = [" ".join(short[k : k + 500]) for k in range(0, len(short), 500)]
        made = [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate([*made, np.zeros(0, np.uint32)])
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != len(short):
            raise ValueError("words without an end")
        rest = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(other, add_special_tokens=False)]
        length = np.concatenate([np.diff(stops, prepend=0), np.array([len(r) for r in rest], np.int64)])
        self.words.update(zip(short + other, range(len(self.length), len(self.length) + len(length)), strict=True))
        at = len(self.flat)
        self.first = np.concatenate([self.first, at + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, flat, *rest])

    def __call__(self, texts: pa.Array) -> tuple[list[int], np.ndarray]:
        """(number of ids of each text with its end id, all ids)."""
        cut = pc.replace_substring_regex(texts, f"([{LETTERS}])([{SIGNS}])", r"\1 \2")
        parts = pc.ascii_split_whitespace(cut)
        coded = pc.dictionary_encode(parts.flatten())
        distinct = coded.dictionary
        plain = pc.match_substring_regex(distinct, f"^[{LETTERS}]+$")
        again = pc.dictionary_encode(pc.if_else(plain, pc.utf8_lower(distinct), distinct))
        words = again.dictionary.to_pylist()
        if len(self.words) > WORDS:
            self._forget()
        new = [w for w in words if w not in self.words and w]
        if new:
            self._learn(new, [bool(_PLAIN.fullmatch(w)) for w in new])
        numbers = np.fromiter(((self.words[w] if w else -1) for w in words), np.int64, len(words))
        at = numbers[again.indices.to_numpy()][coded.indices.to_numpy()]
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        kept = at >= 0  # white space at a text's ends leaves empty parts
        stops = np.concatenate([[0], np.cumsum(kept)])[offsets[1:]]
        at = np.insert(at[kept], stops, 0)
        length = self.length[at]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.first[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        counts = np.diff(ends[np.flatnonzero(at == 0)], prepend=0)
        return counts.tolist(), ids


_PLAIN = re.compile("[a-zà-öø-ÿß]+")
# The forms of normaliser and splitter that :class:`WordEncoder` relies on.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def text_encoder(spec: str, end_id: int):
    """Arrow texts to (numbers of ids, ids), as ``tokenizers`` encodes them, each with its
    end id; by words where the vocabulary allows it."""
    try:
        return WordEncoder(spec, end_id)
    except (ValueError, KeyError):
        from tokenizers import Tokenizer

        held = Tokenizer.from_str(spec)
        held.no_truncation()
        held.no_padding()

        def run(texts: pa.Array) -> tuple[list[int], np.ndarray]:
            made = [np.array([*e.ids, end_id], np.uint32) for e in held.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return [len(m) for m in made], np.concatenate([*made, np.zeros(0, np.uint32)])

        return run


# Folders of files

_MANIFEST = "part int, file string, documents long, ids long, bytes long"
#: Bytes of text that are encoded at once.
TEXT_BYTES = 4 << 20


def _in_bytes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a part's texts hold TEXT_BYTES or are one text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def _ranged(docs: DataFrame, name, *ties) -> DataFrame:
    """Rows in ranges of ``name``, sorted in each (null first). Rows of one name part at
    ``ties`` and in the end by their place, so a name may hold any share of the rows."""
    n = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = docs.select(name.cast("long").alias("id_"), *ties).withColumn("place_", F.monotonically_increasing_id())
    keys = [F.col("id_").asc_nulls_first(), *(F.xxhash64(c) for c in held.columns[1:-1]), F.col("place_")]
    return held.repartitionByRange(min(n, MOST_FILES), *keys).sortWithinPartitions(*keys).drop("place_")


def write_texts(docs: DataFrame, vocab_spec: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending order of
    ``id_col`` to new files in ``folder``; the manifest's rows, which are stored there too.

    A null or empty text is the end id alone; null ids come first; rows of one id follow the
    hash of their texts, and repeated rows are documents of their own. A very long text is
    encoded as a whole and packed in parts. An empty table writes no file. Other columns,
    whatever they are called, are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab_spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = common.per_worker("words", shared.value + f"\0{end_id}", lambda s: text_encoder(s.rpartition("\0")[0], end_id))
        yield from _written((b.column(0).to_pylist(), *encode(b.column(1))) for b in _in_bytes(batches, 1))

    _written = _file_of(folder, share)
    ranged = _ranged(docs, docs[id_col], common.whole(docs[text_col]).alias("text_"))
    return _listed(ranged.mapInArrow(run, _MANIFEST), folder)


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", ids_col: str = "ids", share: float = SHARE) -> DataFrame:
    """The same for ids that are known: ``ids_col`` holds arrays of numbers from 0 to
    2^32 - 1 (null: none), which are written as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written((b.column(0).to_pylist(), pc.list_value_length(b.column(1)).to_pylist(), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint32)) for b in batches)

    _written = _file_of(folder, share)
    ids = F.coalesce(docs[ids_col].cast("array<long>"), F.array().cast("array<long>")).alias("ids_")
    return _listed(_ranged(docs, docs[id_col], ids).mapInArrow(run, _MANIFEST), folder)


def _file_of(folder: str, share: float):
    """What a task does: one file of all its documents, under a name of its own."""

    def run(parts: Iterator[tuple[list, list[int], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        part, name, out = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.pfor", None
        for names, counts, ids in parts:
            if out is None:
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path)
                out = Writer(f"{folder}/{name}", share)
            out.add(names, counts, ids)
        if out is not None:
            size = out.close()
            row = (part, name, len(out.docs), out.ids, size)
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]]), *(pa.array([v], pa.int64()) for v in row[2:])], names=["part", "file", "documents", "ids", "bytes"])

    return run


def _listed(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.parquet(f"{folder}/manifest")
    return manifest(rows.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(part, file, documents, ids, bytes, base): the files in order, and the ids before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str, id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids): every document of a folder with the number of ids before
    it and its ids; with ``digests`` ids_crc32, the checksum of its ids as little-endian
    unsigned 32-bit integers, in place of the ids.

    Tasks take slices of files and seek to their first block."""
    files = manifest(spark, folder)
    total = files.agg(F.sum(F.ceil(F.col("ids") / SLICE))).first()[0] or 1
    slices = files.select("file", "base", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("ids") / SLICE) - 1, F.lit(0)).cast("long"))).alias("k"))
    last = "ids_crc32 long" if digests else "ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base, ids, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, rows, size = Reader(f"{folder}/{name}"), [], 0
                for doc, start, parts in file.documents(k * SLICE, (k + 1) * SLICE if (k + 1) * SLICE < ids else 1 << 62):
                    if digests:
                        crc, n = 0, 0
                        for p in parts:
                            crc, n = crc32(np.ascontiguousarray(p, "<u4"), crc), n + len(p)
                        rows.append((doc, base + start, n, crc))
                    else:
                        held = np.concatenate([*parts, np.zeros(0, np.uint32)])
                        rows.append((doc, base + start, len(held), held))
                        size += len(held)
                    if len(rows) >= 4096 or size >= AT_ONCE:
                        yield _rows(rows, digests, id_col)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, digests, id_col)

    dealt = slices.repartition(max(1, min(int(total), 100_000)))
    return dealt.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, {last}")


def _rows(rows: list[tuple], digests: bool, id_col: str) -> pa.RecordBatch:
    ids, starts, counts, last = zip(*rows, strict=True)
    if digests:
        end = pa.array(last, pa.int64())
    else:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        end = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(last).astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts, counts)] + [end], names=[id_col, "start", "n_tokens", "ids_crc32" if digests else "ids"])


def round_trip(docs: DataFrame, vocab_spec: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every text, read back from files of its ids, which
    are deleted when the rows are known. Cases as for :func:`write_texts`."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    try:
        write_texts(docs, vocab_spec, folder, end_id, id_col, text_col)
        return common.stored(read(spark, folder, id_col, digests=True), "digests")
    finally:
        discard(spark, folder)
