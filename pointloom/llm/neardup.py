"""Near-duplicate documents by consistent weighted sampling.

A text is a set of five-word shingles weighted by TF-IDF. Improved consistent weighted
sampling (one sample per hash function, equal for two texts with the probability of their
weighted Jaccard similarity) gives a sketch; bands of the sketch propose pairs and the
exact weighted Jaccard similarity of the whole texts decides them.

Texts of equal shingle weights are one node from the start, so copies never pair up. Nodes
whose unshared weight rules links out leave their buckets. Comparisons with leaders thin
out heavy buckets; then all pairs of a bucket that no links join yet are compared, block by
block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS, SIMILARITY = 5, 0.8
#: Bands and samples in a band: a pair of similarity 0.8 meets in a band with a
#: probability of 99.8 %, one of 0.85 with 99.99 %, one of 0.3 with 9 %.
BANDS, ROWS = 12, 4
#: Inverse document frequencies fall with the logarithm of a shingle's document frequency,
#: from 1 at a share of FLOOR of the documents (and below) to LEAST_IDF at all of them. So
#: boilerplate weighs less than unique text, and near-copies in a group that holds a third
#: of the corpus are still alike.
FLOOR, LEAST_IDF = 1 / 256, 0.5
#: Document frequencies are counted in a sketch of COUNTER_ROWS rows of 2^COUNTER_BITS
#: counters, 4 MB at any corpus size. It never counts too few; it counts too many by (mean
#: distinct shingles of a document) / 2^COUNTER_BITS of the documents on average (0.1 % for
#: 560 shingles), which lies below FLOOR. It moves in rows of SLOT counters.
COUNTER_BITS, COUNTER_ROWS, SLOT = 19, 2, 1024
#: Rows of one file of the steps that are short rows.
FILE_ROWS = 50_000
#: Bytes of text hashed at once.
BLOCK = 400_000
#: Rounds with leaders in heavy buckets; they spare comparisons and decide nothing.
LEADER_ROUNDS = 3
#: Weight of the sets on each side of a block of comparisons (8 to 24 bytes a unit).
BLOCK_WEIGHT = 400_000

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_SHINGLE = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAMPLE = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COUNTER = _rng.integers(0, 2**63, COUNTER_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Variates come from tables of 2^TABLE_BITS entries: two shingles share an entry with a
#: probability of one in a million, which can only propose a pair or pass one over in one
#: sample; similarities are computed on the shingles themselves.
TABLE_BITS = 20


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        t[a:b] = True
    return t


_IS_WORD = _word_bytes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def powers(n: int, of: int) -> np.ndarray:
    p = np.full(n, of % 2**64, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Shingler:
    """Weighted shingles of blocks of texts, all at once."""

    def __init__(self) -> None:
        self._up = self._down = powers(1, 1)

    def _reach(self, n: int) -> None:
        if len(self._up) < n:
            self._up, self._down = powers(n, _BASE), powers(n, pow(_BASE, -1, 2**64))

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(document, shingle) sorted, with repeats: shingles are 48-bit hashes of five
        words; a text of fewer words is one shingle; a text without words has none."""
        data = [t.lower().encode("utf-8", "replace") for t in texts]
        raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        n = len(raw)
        self._reach(n + 1)
        inside = _IS_WORD[raw]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * self._up[:n], out=sums[1:])
        word = mixed((sums[ends] - sums[starts]) * self._down[starts])
        bounds = np.cumsum([len(d) + 1 for d in data])
        of = np.searchsorted(bounds, starts, side="right")
        per = np.bincount(of, minlength=len(texts))
        if len(word) >= WORDS:
            m = len(word) - WORDS + 1
            h = reduce(lambda a, j: a + mixed(word[j : j + m] + _SHINGLE[j]) * _SHINGLE[j], range(WORDS), np.zeros(m, dtype=np.uint64))
            whole = of[:m] == of[WORDS - 1 :]
            h, doc = mixed(h[whole]), of[:m][whole]
        else:
            h, doc = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        first = np.cumsum(per) - per
        short = np.flatnonzero((per > 0) & (per < WORDS))
        if len(short):
            own = np.zeros(len(short), dtype=np.uint64)
            for j in range(WORDS - 1):
                has = per[short] > j
                own[has] += mixed(word[first[short][has] + j] + _SHINGLE[j]) * _SHINGLE[j]
            h, doc = np.concatenate([h, mixed(own + per[short].astype(np.uint64))]), np.concatenate([doc, short])
        key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
        return (key >> np.uint64(48)).astype(np.int64), key & np.uint64(2**48 - 1)

    def weighted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, shingle, term frequency), distinct and sorted."""
        doc, s = self.flat(texts)
        new = np.flatnonzero((np.diff(s, prepend=np.uint64(2**63)) != 0) | (np.diff(doc, prepend=-1) != 0))
        return doc[new], s[new], np.diff(new, append=len(s)).astype(np.float32)


def blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Stretches of batches with about BLOCK bytes of text (at least one row, at most 2^15)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text_at)).to_numpy()
        at, size = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if k > at and (size + n > BLOCK or k - at >= 2**15):
                yield batch.slice(at, k - at), batch.column(text_at).slice(at, k - at).to_pylist()
                at, size = k, 0
            size += n
        if at < len(sizes):
            yield batch.slice(at), batch.column(text_at).slice(at).to_pylist()


def counters(s: np.ndarray) -> list[np.ndarray]:
    """The places of shingles in the rows of the sketch, the rows one after the other."""
    size = 1 << COUNTER_BITS
    return [((s * _COUNTER[r]) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64) + r * size for r in range(COUNTER_ROWS)]


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """The count sketch of all documents (column ``text``): every task fills its own, sums by
    slot follow, and the driver gets one sketch."""
    width = COUNTER_ROWS << COUNTER_BITS

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, held, n = Shingler(), np.zeros(width, dtype=np.uint32), [], 0
        any_rows = False
        for _, texts in blocks(batches, 0):
            any_rows = True
            held.append(shingler.weighted(texts)[1])
            n += len(held[-1])
            if n > 500_000:
                total += np.bincount(np.concatenate(counters(np.concatenate(held))), minlength=width).astype(np.uint32)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(counters(np.concatenate(held))), minlength=width).astype(np.uint32)
        if any_rows:
            rows = total.reshape(-1, SLOT)
            used = np.flatnonzero(rows.any(axis=1))
            for at in range(0, len(used), 256):
                some = used[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[k].tobytes() for k in some], pa.binary())], names=["slot", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(counts, np.uint32).astype(np.uint64)
                held[slot] = held[slot] + more if slot in held else more
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["slot", "counts"])

    parts = docs.select("text").mapInArrow(filled, "slot int, counts binary").repartition("slot").mapInArrow(summed, "slot int, counts binary").toArrow()
    out = np.zeros(width, dtype=np.uint64).reshape(-1, SLOT)
    for slot, counts in zip(parts["slot"].to_pylist(), parts["counts"].to_pylist(), strict=True):
        out[slot] = np.frombuffer(counts, np.uint64)
    return out.reshape(-1)


class Weights:
    """TF-IDF weights: term frequency times the inverse document frequency of the sketch."""

    def __init__(self, frequencies: np.ndarray, n_docs: int):
        share = np.maximum(frequencies / max(n_docs, 1), FLOOR)
        idf = LEAST_IDF + (1 - LEAST_IDF) * np.log(np.minimum(share, 1.0)) / np.log(FLOOR)
        self.idf = idf.astype(np.float32)

    def __call__(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        # the row with the least count has the highest frequency's inverse
        return tf * reduce(np.maximum, [self.idf.take(at) for at in counters(s)])


class Sampler:
    """Improved consistent weighted sampling of flat weighted sets.

    Gamma(2, 1) variates r and c and a uniform b are read from a table by a hash of the
    shingle; then t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r, and the least
    ln a of a set is its sample. That value depends on shingle and t alone, so it also
    names the sample. For weight 1, t is 0 and ln a is a table of its own."""

    def __init__(self) -> None:
        rng, n = np.random.default_rng(7), 2**TABLE_BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.b = rng.random(n).astype(np.float32)
        self.plain = self.log_c + self.r * self.b - self.r

    def sketch(self, s: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (sets x BANDS*ROWS) as the bits of their values."""
        out = np.empty((len(starts), len(_SAMPLE)), dtype=np.float32)
        odd = np.flatnonzero(w != 1)
        log_w = np.log(w[odd])
        for k, factor in enumerate(_SAMPLE):
            at = ((s * factor) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            value = self.plain.take(at)
            if len(odd):
                i = at[odd]
                r, b = self.r[i], self.b[i]
                t = np.floor(log_w / r + b)
                value[odd] = self.log_c[i] - r * (t - b) - r
            out[:, k] = np.minimum.reduceat(value, starts)
        return out.view(np.uint32)


def sketches(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(id, th, node, bands): node names the weighted set (or, without words, the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = common.opened(shared)
        shingler, sampler = Shingler(), common.per_worker("sampler", "20", lambda _: Sampler())
        for batch, texts in blocks(batches, 2):
            doc, s, tf = shingler.weighted(texts)
            w = weights(s, tf)
            there, starts = np.unique(doc, return_index=True)
            node = np.zeros((len(texts), 2), dtype=np.uint64)
            bands: list = [None] * len(texts)
            if len(there):
                bits = w.view(np.uint32).astype(np.uint64)
                one, two = mixed(s + bits * _MIX), mixed(s * _SHINGLE[0] + bits * _SHINGLE[1])
                node[there, 0], node[there, 1] = mixed(np.add.reduceat(one, starts)), mixed(np.add.reduceat(two, starts))
                samples = sampler.sketch(s, w, starts).astype(np.uint64)
                key = np.zeros((len(there), BANDS), dtype=np.uint64)
                for k in range(ROWS):
                    key = mixed(key * _MIX + samples[:, k::ROWS] + np.uint64(1))
                for d, row in zip(there.tolist(), key.view(np.int64).tolist(), strict=True):
                    bands[d] = row
            names = [n.tobytes() for n in node]
            for d in np.setdiff1d(np.arange(len(texts)), there):
                names[d] = sha256(texts[d].encode("utf-8", "replace")).digest()[:16]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "th", "node", "bands"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, node binary, bands array<long>")


def weighted_sets(docs: DataFrame, shared: Broadcast, wanted: DataFrame) -> DataFrame:
    """(node, shingles, weights, total) of the ``wanted`` (node, id, th): one whole text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shingler = common.opened(shared), Shingler()
        for batch, texts in blocks(batches, 1):
            doc, s, tf = shingler.weighted(texts)
            w = weights(s, tf)
            cut = np.searchsorted(doc, np.arange(1, len(texts)))
            sets = [x.tobytes() for x in np.split(s, cut)]
            split = np.split(w, cut)
            loads = [None if (x == 1).all() else x.tobytes() for x in split]
            totals = [float(x.sum(dtype=float)) for x in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(loads, pa.binary()), pa.array(totals)], names=["node", "shingles", "weights", "total"])

    one = wanted.groupBy("id", "th").agg(F.min("node").alias("node"))
    texts = docs.join(one, docs["th"].eqNullSafe(one["th"]) & docs["id"].eqNullSafe(one["id"])).select("node", "text")
    return texts.mapInArrow(run, "node binary, shingles binary, weights binary, total double").dropDuplicates(["node"])


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (shingles, weights or None)."""
    sa, sb = np.frombuffer(a[0], np.uint64), np.frombuffer(b[0], np.uint64)
    if not len(sa) or not len(sb):
        return 0.0
    at = np.minimum(np.searchsorted(sa, sb), len(sa) - 1)
    both = sa[at] == sb
    if a[1] is None and b[1] is None:
        n = int(both.sum())
        return n / (len(sa) + len(sb) - n)
    wa = np.frombuffer(a[1], np.float32).astype(float) if a[1] else np.ones(len(sa))
    wb = np.frombuffer(b[1], np.float32).astype(float) if b[1] else np.ones(len(sb))
    least = np.minimum(wa[at[both]], wb[both]).sum()
    return float(least / (wa.sum() + wb.sum() - least))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, node, like): whether the exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, 500):
            c = [x.to_pylist() for x in batch.columns]
            like = [similarity((p, q), (r, s)) >= SIMILARITY for p, q, r, s in zip(*c[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like)], names=["leader", "node", "like"])

    left = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("s1"), F.col("weights").alias("w1"))
    return pairs.join(left, "leader").join(sets.drop("total"), "node").select("leader", "node", "s1", "w1", "shingles", "weights").mapInArrow(run, "leader binary, node binary, like boolean")


def unshared(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, rare, total): each node's weight and the share of it in shingles that no other
    of ``nodes`` has. No similarity within ``nodes`` exceeds 1 - rare."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, 200):
            s = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            w = [np.frombuffer(x, np.float32) if x else np.ones(len(y), np.float32) for x, y in zip(batch.column(2).to_pylist(), s, strict=True)]
            own = np.repeat(batch.column(0).to_numpy(), [len(x) for x in s])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s)), pa.array(own), pa.array(np.concatenate(w))], names=["shingle", "own", "w"])

    held = sets.join(nodes, "node", "left_semi")
    rows = held.select(F.xxhash64("node"), "shingles", "weights").mapInArrow(listed, "shingle long, own long, w float")
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("own"), F.min("w").alias("w")).where("n = 1")
    lone = alone.groupBy("own").agg(F.sum(F.col("w").cast("double")).alias("lone"))
    return held.select("node", "total").join(lone, F.xxhash64("node") == F.col("own"), "left").select("node", F.coalesce(F.try_divide("lone", "total"), F.lit(0.0)).alias("rare"), "total")


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified (leader, node) links of bucket members (band, key, node): any two nodes of a
    bucket that reach the threshold are joined by a path of links.

    First go nodes whose unshared weight alone rules a link out (an exact bound; it clears
    buckets that a common passage or heavily edited copies fill), buckets left with one node,
    and all but one of the buckets with the same nodes. Buckets too heavy for one block of
    comparisons are thinned by ``leaders``; then ``crossing`` compares what no links join."""
    bucket = ["band", "key"]
    files = -(-members.count() // FILE_ROWS)
    shares = common.stored(unshared(sets, members.select("node").distinct()), "shares", files)
    able = members.join(shares.where(F.col("rare") <= 1 - SIMILARITY + 1e-6), "node")
    same = ["n", "one", "two"]
    busy = able.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"), F.sum("total").alias("weight")).where("n > 1")
    first = busy.groupBy(*same).agg(F.min(F.struct(*bucket, "weight")).alias("b")).select("b.*")
    able = common.stored(able.join(first, bucket).select(*bucket, "node", "rare", "total", "weight"), "able", files)
    heavy = able.where(F.col("weight") > BLOCK_WEIGHT).drop("weight")
    if heavy.isEmpty():
        return crossing(able, sets, None)
    found = leaders(heavy, sets, files)
    return found.unionByName(crossing(able, sets, components(found)))


def leaders(members: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """Verified (leader, node) links within heavy buckets, at most (the bucket's size times
    its leaders) of pairs a round.

    In round n each bucket's open nodes put up 4^(n-1) leaders, those with the least unshared
    weight, and every node of the bucket is compared with them, unless their unshared
    weights rule a link out. Nodes like a leader, and leaders, are settled; buckets with
    none open sit out. This spares comparisons and decides nothing."""
    bucket = ["band", "key"]
    found: list[DataFrame] = []
    able, lead = members.withColumn("open", F.lit(True)), 1
    for round_ in range(LEADER_ROUNDS):
        part = F.pmod(F.xxhash64("node"), F.lit(lead)).alias("part")
        heads = able.where("open").groupBy(*bucket, part).agg(F.min(F.struct("rare", "node", "total")).alias("h")).select(*bucket, F.col("h.node").alias("leader"), (F.col("h.total") * (1 - F.col("h.rare"))).alias("ls"), F.col("h.total").alias("lt"))
        # what the two can share at most must reach the threshold over what both have
        shared = F.least(F.col("total") * (1 - F.col("rare")), F.col("ls"))
        able_, heads_ = able.alias("a"), heads.alias("h")
        near = (F.col("a.band") == F.col("h.band")) & (F.col("a.key") == F.col("h.key")) & (F.col("node") != F.col("leader")) & (shared >= (SIMILARITY - 1e-6) * (F.col("total") + F.col("lt") - shared))
        met = able_.join(heads_, near).select("a.band", "a.key", "node", "leader")
        pairs = met.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node")).distinct()
        judged = common.stored(verified(pairs, sets), "judged").where("like").select("leader", "node")
        found.append(judged)
        if round_ == LEADER_ROUNDS - 1:
            break
        both = judged.unionByName(judged.select(F.col("node").alias("leader"), F.col("leader").alias("node")))
        liked = met.join(both, ["leader", "node"], "left_semi").select(*bucket, "node")
        settled = liked.unionByName(heads.select(*bucket, F.col("leader").alias("node"))).distinct().withColumn("done", F.lit(True))
        after = able.join(settled, [*bucket, "node"], "left").select(*bucket, "node", "rare", "total", (F.col("open") & F.col("done").isNull()).alias("open"))
        going = after.groupBy(*bucket).agg(F.max("open").alias("any")).where("any").select(*bucket)
        able = common.stored(after.join(going, bucket, "left_semi"), "open", files)
        if able.isEmpty():
            break
        lead *= 4
    return reduce(DataFrame.unionByName, found).distinct()


def crossing(members: DataFrame, sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links (leader, node) between members (band, key, node, rare, total) of a bucket whose
    labels differ; without ``labels`` each node is its own.

    In each bucket the nodes outside its largest component are rows and all nodes are
    columns; both are dealt by hash into parts of about BLOCK_WEIGHT, and every part of the
    rows meets every part of the columns. Of a pair of different components one is a row, so
    each such pair is compared, unless links found meanwhile join the two. Sets move once per
    part of the other side, pairs never become rows of a table."""
    bucket = ["band", "key"]
    if labels is None:
        named = members.withColumn("label", F.col("node"))
    else:
        named = members.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("load"))
    parts = lambda w: F.greatest(F.lit(1), F.ceil(w / BLOCK_WEIGHT)).cast("int")
    mixed = counts.groupBy(*bucket).agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label", "load")).alias("most"), F.sum("load").alias("all")).where("labels > 1")
    sizes = mixed.select(*bucket, F.col("most.label").alias("main"), parts(F.col("all") - F.col("most.load")).alias("down"), parts(F.col("all")).alias("across"))
    minor = F.col("label") != F.col("main")
    placed = named.join(sizes, bucket)
    alone = (F.col("down") == 1) & (F.col("across") == 1)
    kept = [*bucket, "node", "label", "main", "rare", "total"]
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = placed.select(*kept, spot("across").alias("j"), (alone & minor).alias("row"), F.lit(True).alias("col"), every("down").alias("i"))
    rows = placed.where(~alone & minor).select(*kept, spot("down").alias("i"), F.lit(True).alias("row"), F.lit(False).alias("col"), every("across").alias("j"))
    met = columns.unionByName(rows).join(sets.select("node", "shingles", "weights"), "node")

    def compared(block: pa.Table) -> pa.Table:
        out = _compared({c: block.column(c).to_pylist() for c in ("node", "label", "main", "rare", "row", "col", "shingles", "weights")})
        return pa.table({"leader": pa.array([a for a, _ in out], pa.binary()), "node": pa.array([b for _, b in out], pa.binary())})

    return common.stored(met.groupBy(*bucket, "i", "j").applyInArrow(compared, "leader binary, node binary").distinct(), "crossing")


def _compared(c: dict[str, list]) -> list[tuple[bytes, bytes]]:
    """Links of a block's rows with its columns, one for each two components they join."""
    s = [np.frombuffer(x, np.uint64) for x in c["shingles"]]
    sizes = np.array([len(x) for x in s])
    starts = np.cumsum(sizes) - sizes
    place = np.unique(np.concatenate(s), return_inverse=True)[1].reshape(-1)
    w = np.concatenate([np.frombuffer(x, np.float32) if x else np.ones(n, np.float32) for x, n in zip(c["weights"], sizes, strict=True)]).astype(float)
    total = np.add.reduceat(w, starts)
    most = total * (1 - np.array(c["rare"]))
    number = {x: k for k, x in enumerate(dict.fromkeys([c["main"][0], *c["label"]]))}
    part = np.array([number[x] for x in c["label"]])
    main, cols = 0, np.flatnonzero(c["col"])
    own, out = np.zeros(int(place.max()) + 1), []
    for a in np.flatnonzero(c["row"]).tolist():
        if part[a] == main:
            continue
        # the same bound as in the rounds
        shared = np.minimum(most[a], most[cols])
        others = cols[(part[cols] != part[a]) & (shared >= (SIMILARITY - 1e-6) * (total[a] + total[cols] - shared))]
        if not len(others):
            continue
        mine = slice(starts[a], starts[a] + sizes[a])
        own[place[mine]] = w[mine]
        ends = np.cumsum(sizes[others])
        at = np.repeat(starts[others] - ends + sizes[others], sizes[others]) + np.arange(ends[-1])
        least = np.add.reduceat(np.minimum(own[place[at]], w[at]), ends - sizes[others])
        own[place[mine]] = 0
        like = others[least / (total[a] + total[others] - least) >= SIMILARITY]
        for b in like.tolist():
            if part[b] != part[a]:
                out.append((c["node"][a], c["node"][b]))
                keep, gone = min(part[a], part[b]), max(part[a], part[b])
                part[part == gone] = keep
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label, ...): the least node of each component, by label spreading with shortcuts;
    every second step cuts its lineage in the shared folder."""
    both = common.stored(edges.select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(edges.select(F.col("node").alias("a"), F.col("leader").alias("b"))), "edges")
    files = -(-both.count() // FILE_ROWS)

    def step(labels: DataFrame) -> DataFrame:
        """The least label of a node and its neighbours, then that label's own label."""
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        next_ = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), "old")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        return next_.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old")

    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = common.stored(step(first.withColumn("old", F.lit(None).cast("binary"))), "labels", files)
    while True:
        labels = common.stored(step(step(labels.withColumn("old", F.col("label")))), "labels", files)
        if labels.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = common.whole(docs[text_col])
    return common.spread(docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_th, class_size, th): each row's near-duplicate class, named by its
    least id and the hash of that row's text, so that classes with null or repeated ids
    stay apart.

    Classes are the components of the verified links. Texts without words (null and empty
    ones too) are near-duplicates of equal texts only. Repeated rows are members of one
    class; null ids are members but name a class only if it has no other. ``th`` is a hash
    of the text that tells rows of one id apart."""
    labelled, named = _classes(_prepared(docs, id_col, text_col))
    return labelled.join(named, "class").select(F.col("id").alias(id_col), F.col("k.id").alias("class_id"), F.col("k.th").alias("class_th"), "class_size", "th")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, th, class) of all rows and (class, k, class_size) of all classes."""
    shared = common.share(rows.sparkSession, Weights(document_frequencies(rows), rows.count()))
    kept = common.stored(sketches(rows, shared), "sketches")
    labels = _labels(rows, shared, kept)
    labelled = kept.select("id", "th", F.col("node").alias("class")) if labels is None else kept.join(labels.select("node", "label"), "node", "left").select("id", "th", F.coalesce("label", "node").alias("class"))
    # partial aggregates: a large class sends one row from each task
    return labelled, labelled.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("k"), F.count(F.lit(1)).alias("class_size"))


def _labels(rows: DataFrame, shared: Broadcast, kept: DataFrame) -> DataFrame | None:
    """(node, label) of the nodes that have links; None if no two nodes share a bucket."""
    nodes = kept.groupBy("node").agg(F.min(F.struct("id", "th")).alias("of"), F.first("bands").alias("bands"))
    spread = nodes.where(F.col("bands").isNotNull()).select("node", "of", F.posexplode("bands").alias("band", "key"))
    crowded = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    with common.scratch(rows.sparkSession) as stay:
        members = common.stored(spread.join(crowded, ["band", "key"]).select("band", "key", "node", "of"), "members")
        if members.isEmpty():
            return None
        wanted = members.select("node", "of.id", "of.th").distinct()
        sets = common.stored(weighted_sets(rows, shared, wanted), "sets")
        labels = components(links(members.select("band", "key", "node"), sets))
        stay.append(labels)
    return labels


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of their class, one row per class, with all
    their columns, whatever these are called.

    Null and empty texts are near-duplicates of each other; null ids stay only if their class
    has no other; of repeated rows one stays; an empty table stays empty."""
    _, named = _classes(_prepared(docs, id_col, text_col))
    own, th, n, first_id, first_th = common.unused(docs, "own_id", "own_th", "own_n", "first_id", "first_th")
    firsts = named.select(F.col("k.id").alias(first_id), F.col("k.th").alias(first_th))
    marked = docs.withColumns({own: docs[id_col].cast("long"), th: F.xxhash64(common.whole(docs[text_col]))})
    kept = marked.join(firsts, F.col(own).eqNullSafe(F.col(first_id)) & (F.col(th) == F.col(first_th)))
    one = F.row_number().over(Window.partitionBy(first_id, first_th).orderBy(th))
    return kept.withColumn(n, one).where(F.col(n) == 1).select(*common.columns(docs))
