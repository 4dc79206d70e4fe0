"""Removal of repeated substrings, blockwise over a synchronised cover of the suffixes.

A suffix is judged by its first ``length`` bytes (400 unless a caller asks for another
length). The cover picks, in any window of that length, the same place for equal windows:
the string of a third of the length with the least hash. So two equal windows meet at their
cover positions, as with a difference cover, but with 0.7 % of the positions instead of 6 %. The cover strings' hashes are the ranks: suffixes are
bucketed by them, one bucket is resolved at a time, and a bucket whose suffixes are all
tied on their whole stretch needs no bytes at all. Only where stretches with one cover
string differ are their bytes read, and the suffixes of one bucket are sorted by name.

Ranks come from a polynomial modulo 2^64, on which regular texts (Thue-Morse words) agree
though they differ; that only puts them into one bucket. What counts as equal is told by
digests of whole stretches and by suffix names modulo two primes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Bytes handled at once; a longer text goes in overlapping parts.
BLOCK = 1 << 20
#: Stretches of one bucket up to which a task sorts it whole; beyond, its suffixes are
#: dealt out one by one.
CROWD = 2000
#: Bytes of one bucket up to which a task sorts it whole, and of stretches named at once.
BUCKET_BYTES = 4 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = 0xA24BAED4963EE407, np.uint64(0x9FB21C651E98DF25)


def core_of(length: int) -> int:
    """Bytes of the cover strings; a window's least one is sought among length - core + 1."""
    return max(1, length * 8 // 25)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(28))


class Hasher:
    """Hashes of all windows of a stretch of bytes: they choose places, but prove nothing equal."""

    def __init__(self, n: int = 0):
        self.reach(n)

    def reach(self, n: int) -> None:
        def powers(of: int) -> np.ndarray:
            p = np.full(n + 1, of % 2**64, dtype=np.uint64)
            p[0] = 1
            return np.cumprod(p, dtype=np.uint64)

        self.n, self.up, self.down = n, powers(_BASE), powers(pow(_BASE, -1, 2**64))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) > self.n:
            self.reach(len(raw))
        out = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        return mixed((sums[length:] - sums[:-length]) * self.down[: len(sums) - length])


#: Moduli of names, primes below 2^31, so that products stay within 64 bits.
PRIMES = (2**31 - 1, 2**31 - 19)
_ROOTS = tuple(int(b) for b in _rng.integers(2**20, 2**31 - 20, 2))


class Namer:
    """Names of strings of bytes: polynomials modulo both PRIMES, 62 bits."""

    def __init__(self) -> None:
        self.n = -1

    def reach(self, n: int) -> None:
        def powers(of: int, prime: int) -> np.ndarray:
            p = np.ones(1, dtype=np.uint64)
            while len(p) <= n:
                p = np.concatenate([p, p * np.uint64(pow(of, len(p), prime)) % np.uint64(prime)])
            return p[: n + 1]

        self.n = n
        self.up = [powers(b, p) for b, p in zip(_ROOTS, PRIMES, strict=True)]
        self.down = [powers(pow(b, -1, p), p) for b, p in zip(_ROOTS, PRIMES, strict=True)]

    def names(self, raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        if len(raw) > self.n:
            self.reach(len(raw))
        out = np.zeros(len(start), dtype=np.uint64)
        for prime, up, down in zip(PRIMES, self.up, self.down, strict=True):
            p = np.uint64(prime)
            sums = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum((_BYTE % p)[raw] * up[: len(raw)] % p, out=sums[1:])
            out = (out << np.uint64(31)) | ((sums[start + length] - sums[start]) % p * down[start] % p)
        return out


def stretches(h: Hasher, raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, cover rank, first start, last start, kind) of all stretches.

    ``raw`` has the documents one after the other, ``bounds`` their limits. A stretch is a
    run of starts with one cover string; its bytes are [first, last + length), of which the
    kind is a digest. Runs of one document with the same rank side by side (periodic text)
    are one stretch, which may repeat itself; its kind is odd."""
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    n = len(raw) - length + 1
    if n <= 0:
        return empty
    sums = h.sums(raw)
    core = h.windows(sums, core_of(length))
    # the least core of each window by 40 bits of hash, ties to the left
    key = ((core >> np.uint64(24)) << np.uint64(24)) | np.arange(len(core), dtype=np.uint64)
    least, width = key, 1
    span = length - core_of(length) + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (least & np.uint64(2**24 - 1)).astype(np.int64)
    rank = core[at]
    doc = np.searchsorted(bounds[1:], np.arange(n), side="right")
    valid = np.arange(n) + length <= bounds[1:][doc]
    new = (np.diff(rank, prepend=~rank[:1]) != 0) | (np.diff(doc, prepend=-1) != 0)
    first = np.flatnonzero(valid & new)
    if not len(first):
        return empty
    # a run ends before the next run, or with the document's last start
    last = np.minimum(np.append(first[1:], n) - 1, bounds[1:][doc[first]] - length)
    place = np.cumsum(np.diff(at, prepend=-1) != 0)
    folded = (place[last] != place[first]).astype(np.uint64)
    view = memoryview(raw)
    kind = np.frombuffer(b"".join([blake2b(view[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]), "<u8")
    return doc[first], rank[first], first, last, (kind & ~np.uint64(1)) | folded


def documents(batches: Iterator[pa.RecordBatch], text_at: int, length: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(row in batch, offset in its text) of each part, the parts' bytes, their bounds.

    A text longer than BLOCK goes in parts that overlap by length - 1 bytes, so that every
    start lies in one part."""
    for batch in batches:
        parts: list[tuple[int, int]] = []
        held: list[bytes] = []
        size = 0

        def made() -> tuple:
            return parts, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), batch

        for row, text in enumerate(batch.column(text_at).to_pylist()):
            data = text.encode("utf-8", "replace")
            for at in range(0, max(1, len(data) - length + 1), BLOCK):
                piece = data[at : at + BLOCK + length - 1]
                if size and size + len(piece) > BLOCK:
                    yield made()
                    parts, held, size = [], [], 0
                parts.append((row, at))
                held.append(piece)
                size += len(piece)
        if parts:
            yield made()


def covered(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, rank, kind, first, n): the stretches of all texts; ``n`` starts from
    ``first`` on in the text."""
    names = ["k1", "k2", "rank", "kind", "first", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for parts, raw, bounds, batch in documents(batches, 2, length):
            doc, rank, first, last, kind = stretches(h, raw, bounds, length)
            row = np.array([r for r, _ in parts], dtype=np.int64)[doc]
            offset = np.array([o for _, o in parts], dtype=np.int64)[doc] - bounds[:-1][doc]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(rank.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(first + offset), pa.array((last - first + 1).astype(np.int32))], names=names)

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, rank long, kind long, first long, n int")


ASK = ("rank", "kind", "first", "n", "times", "kinds")
HELD = "k1 long, k2 long, rank long, kind long, first long, n int, times long, kinds long, bytes binary"
RUNS = "k1 long, k2 long, first long, runs array<struct<lo: int, hi: int>>"
_RUNS_TYPE = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def bytes_of(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The stretches at ``places`` with their bytes, cut from the whole texts."""
    schema = pa.schema([(c, pa.int32() if c == "n" else pa.int64()) for c in ("k1", "k2", *ASK)] + [("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, 200):
            out: dict[str, list] = {c: [] for c in schema.names}
            size = 0
            for k1, k2, text, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "replace")
                for a in asks:
                    for c, v in a.items():
                        out[c].append(v)
                    out["k1"].append(k1)
                    out["k2"].append(k2)
                    out["bytes"].append(data[a["first"] : a["first"] + a["n"] + length - 1])
                    size += len(out["bytes"][-1])
                    if size > BUCKET_BYTES:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out, size = {c: [] for c in schema.names}, 0
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    asked = places.groupBy("k1", "k2").agg(F.collect_list(F.struct(*ASK)).alias("asks"))
    return docs.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asks").mapInArrow(run, HELD)


def _runs(marks: np.ndarray) -> list[dict]:
    edge = np.diff(marks.astype(np.int8), prepend=0, append=0)
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def sorted_buckets(held: DataFrame, length: int) -> DataFrame:
    """The repeated starts of single stretches among those of their bucket: one bucket
    after the other, its suffixes sorted by name (of their ``length`` bytes, beside the
    bucket's rank). Equal rows of equal documents count once."""

    def resolved(bucket: dict, namer: Namer) -> Iterator[dict]:
        rows = list(bucket.values())
        raw = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        begin = np.cumsum([0, *(len(r["bytes"]) for r in rows)])[:-1]
        counts = np.array([r["n"] for r in rows])
        start = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        _, inverse, times = np.unique(namer.names(raw, start, length), return_inverse=True, return_counts=True)
        for r, marks in zip(rows, np.split(times[inverse] > 1, np.cumsum(counts)[:-1]), strict=True):
            if r["times"] == 1 and marks.any():
                yield {"k1": r["k1"], "k2": r["k2"], "first": r["first"], "runs": _runs(marks)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer, rank, bucket = Namer(), None, {}
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("runs", _RUNS_TYPE)])
        for batch in common.in_batches(batches, 1000):
            out: list[dict] = []
            for row in batch.to_pylist():
                if row["rank"] != rank:
                    out += resolved(bucket, namer) if bucket else ()
                    rank, bucket = row["rank"], {}
                bucket[row["kind"]] = row
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if bucket:
            yield pa.RecordBatch.from_pylist(list(resolved(bucket, namer)), schema=schema)

    return held.repartition("rank").sortWithinPartitions("rank").mapInArrow(run, RUNS)


def dealt_suffixes(held: DataFrame, length: int) -> DataFrame:
    """The same for crowded buckets: every suffix is a row (rank, name) of its own and equal
    ones are counted with partial sums, so that no task holds a bucket."""
    own = ["k1", "k2", "first", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer = Namer()
        for batch in batches:
            sizes = pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64)
            block = np.cumsum(sizes) // BUCKET_BYTES
            for at, n in zip(*np.unique(block, return_index=True, return_counts=True)[1:], strict=True):
                some = batch.slice(int(at), int(n))
                names = [namer.names(np.frombuffer(b, np.uint8), np.arange(len(b) - length + 1), length).view(np.int64) for b in some.column("bytes").to_pylist()]
                offsets = pa.array(np.cumsum([0, *map(len, names)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in own), some.column("rank"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(names)))], names=[*own, "rank", "names"])

    named = common.stored(held.mapInArrow(run, "k1 long, k2 long, first long, times long, rank long, names array<long>").distinct(), "names")
    each = named.select(*own, "rank", F.posexplode("names").alias("at", "name"))
    repeated = each.groupBy("rank", "name").agg(F.count(F.lit(1)).alias("found")).where("found > 1")
    hit = each.where("times = 1").join(repeated, ["rank", "name"])
    marked = hit.groupBy("k1", "k2", "first").agg(F.collect_list("at").alias("ats"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, 1000):
            runs = []
            for ats in batch.column(3).to_pylist():
                marks = np.zeros(max(ats) + 1, bool)
                marks[ats] = True
                runs.append(_runs(marks))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(runs, _RUNS_TYPE)], names=["k1", "k2", "first", "runs"])

    return marked.mapInArrow(joined, RUNS)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans): byte spans (lo, hi) of each text that repeated strings of ``length``
    bytes cover, in overlapping pieces and lists; texts without any are left out. A stretch
    has one row at most."""
    stretch = ["rank", "kind"]
    # equal stretches are counted on the map side first
    kinds = common.stored(covered(docs, length).groupBy(*stretch).agg(F.count(F.lit(1)).alias("times")), "kinds")
    tied = kinds.groupBy("rank").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("all"), F.sum((F.col("times") == 1).cast("long")).alias("single"))
    folded = F.col("kind").bitwiseAND(F.lit(1)) == 1
    known = kinds.join(tied, "rank").where((F.col("all") > 1) | folded)
    places = common.stored(covered(docs, length).join(known.select(*stretch, "times", "kinds", "single"), stretch), "places")
    whole = places.where("times > 1").select("k1", "k2", F.array(F.struct(F.col("first").alias("lo"), (F.col("first") + F.col("n") + length - 1).alias("hi"))).alias("spans"))
    # what is left open: buckets with a single stretch beside others or folded
    unsure = places.where((F.col("single") > 0) & ((F.col("kinds") > 1) | folded))
    one = unsure.groupBy(*stretch).agg(F.min(F.struct("k1", "k2", *ASK[2:])).alias("p")).select(*stretch, "p.*")
    loads = one.groupBy("rank").agg(F.sum(F.col("n") + length - 1).alias("load"), F.max("kinds").alias("kinds"))
    heavy = common.stored(loads.where((F.col("load") > BUCKET_BYTES) | (F.col("kinds") > CROWD)).select("rank"), "heavy")
    held = common.stored(bytes_of(docs, one, length), "bytes")
    if heavy.isEmpty():
        parts = sorted_buckets(held, length)
    else:
        parts = sorted_buckets(held.join(heavy, "rank", "left_anti").select(*held.columns), length).unionByName(dealt_suffixes(held.join(heavy, "rank", "left_semi").select(*held.columns), length))
    open_ = parts.select("k1", "k2", F.transform("runs", lambda r: F.struct((F.col("first") + r["lo"]).alias("lo"), (F.col("first") + r["hi"] + length - 1).alias("hi"))).alias("spans"))
    return whole.unionByName(open_)


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what stays, bytes removed, maximal runs removed)."""
    out, at, gone, runs, end = [], 0, 0, 0, -1
    for lo, hi in sorted(spans):
        if lo > end:
            out.append(data[at:lo])
            runs += 1
            gone += hi - lo
        elif hi > end:
            gone += hi - end
        end = max(end, hi)
        at = end
    return b"".join([*out, data[at:]]), gone, runs


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """``docs`` with a last column (array of lo, hi), null where nothing repeats."""
    text = common.whole(docs[text_col])
    keys = [F.xxhash64(docs[id_col], text), F.xxhash64(text, docs[id_col], F.lit(1))]
    plain = common.spread(docs.select(keys[0].alias("k1"), keys[1].alias("k2"), text.alias("text")))
    one, two, to1, to2, name = common.unused(docs, "k1", "k2", "to1", "to2", "spans")
    spans = repeated_spans(plain, length).groupBy(F.col("k1").alias(to1), F.col("k2").alias(to2)).agg(F.flatten(F.collect_list("spans")).alias(name))
    keyed = docs.withColumns({one: keys[0], two: keys[1]})
    return keyed.join(spans, (F.col(one) == F.col(to1)) & (F.col(two) == F.col(to2)), "left").select(*common.columns(docs), name)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every whole text as UTF-8 bytes.

    Removed is each byte in a string of ``length`` bytes that starts anywhere else too, in
    the same text or another. Shorter texts (null and empty ones too) stay whole; very long
    ones go in overlapping parts. Rows of equal text, repeated rows too, are copies of each
    other and lose all such strings. Other columns are ignored, an empty table gives none."""
    rows = docs.select(docs[id_col].cast("long").alias(id_col), common.whole(docs[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, 500):
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                kept, gone, runs = cut(data, [(s["lo"], s["hi"]) for s in spans or ()])
                for c, v in zip(out, (len(data), gone, runs, sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(rows, id_col, "text", length).mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings of ``length`` bytes or more cut out of the text; a
    character of which only a part stays goes as well. Texts without repeats stay as they
    are, null ones null; other columns stay, whatever they are called."""
    marked = _with_spans(docs, id_col, text_col, length)
    at, docs_names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, 500):
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    text = cut(text.encode("utf-8", "replace"), [(s["lo"], s["hi"]) for s in spans])[0].decode("utf-8", "ignore")
                texts.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    plain = marked.toDF(*(f"c{k}" for k in range(len(marked.columns))))  # any names may come
    return plain.mapInArrow(run, docs.schema)
