"""URL filtering by host-suffix and path-prefix rules.

Rules are listed as canonical (host, path prefix) keys. Every URL yields the keys that
could list it: each suffix of its host with each prefix of its path whose length some
rule has. A blocked Bloom filter passes the possible hits and an exact hash join with the
rules removes the false positives, so verdicts are exact. The filter is built by tasks, one
segment of its blocks each, and is at most MOST_BLOCKS blocks large: beyond 16 million
rules it has fewer bits for each, passes more, and the join is as exact as before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import opened, share, whole

#: Bits a key; blocks of a filter (32 bytes each, 64 MB in all) and of one of its segments.
BITS_PER_KEY, MOST_BLOCKS, SEGMENT = 16, 1 << 21, 1 << 11
#: One odd multiplier for each of a block's eight 32-bit lanes.
LANES = np.array([2 * (0x5851F42D * (k + 1) % 2**31) + 1 for k in range(8)], dtype=np.uint64) & np.uint64(0xFFFFFFFF)


def _place(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, one bit for each of its lanes) of each hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = h & np.uint64(0xFFFFFFFF)
    shift = ((low[:, None] * LANES) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return block.astype(np.int64), (np.uint64(1) << shift).astype(np.uint32)


class BlockedBloom:
    """Blocks of eight 32-bit lanes; a key sets one bit in each lane of one block, so a
    probe touches one cache line."""

    def __init__(self, blocks: int):
        self.blocks = np.zeros((blocks, 8), dtype=np.uint32)

    @staticmethod
    def size(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
        return max(1, min(MOST_BLOCKS, -(-keys * bits_per_key // 256)))

    def add(self, hashes: np.ndarray, first: int = 0, of: int | None = None) -> None:
        """Enter keys; these blocks are those from ``first`` on of a filter of ``of``."""
        block, bits = _place(hashes, of or len(self.blocks))
        for lane in range(8):
            np.bitwise_or.at(self.blocks[:, lane], block - first, bits[:, lane])

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = _place(hashes, len(self.blocks))
        return ((self.blocks[block] & bits) == bits).all(axis=1)


def built(hashes: DataFrame, keys: int) -> BlockedBloom:
    """The filter of a column ``h``: keys go to the task of their segment, which sends its
    finished blocks, so the driver gets the filter and no key."""
    n = BlockedBloom.size(keys)

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((_place(h, n)[0] // SEGMENT).astype(np.int32))], names=["h", "segment"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, BlockedBloom] = {}
        for batch in batches:
            h, segment = (c.to_numpy() for c in batch.columns)
            for s in np.unique(segment).tolist():
                own = held.setdefault(s, BlockedBloom(min(SEGMENT, n - s * SEGMENT)))
                own.add(h[segment == s], s * SEGMENT, n)
        for s, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([own.blocks.tobytes()], pa.binary())], names=["segment", "blocks"])

    rows = hashes.mapInArrow(segmented, "h long, segment int").repartition("segment").mapInArrow(filled, "segment int, blocks binary").toArrow()
    out = BlockedBloom(n)
    for s, blocks in zip(rows["segment"].to_pylist(), rows["blocks"].to_pylist(), strict=True):
        part = np.frombuffer(blocks, np.uint32).reshape(-1, 8)
        out.blocks[s * SEGMENT : s * SEGMENT + len(part)] |= part
    return out


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end; A-Z lower-cased; '' if none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' if there is no '://'."""
    return F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(" "), path)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; the longest fitting rule decides.

    ``rules``: host, path, verdict; repeated keys count once (the verdict 'block' wins). Of
    equally long rules that with the longer host wins. Null URLs and URLs without '://'
    have empty host and path and get ``default``. Repeated rows stay, other columns are
    ignored, an empty rule list gives every row ``default``."""
    spark = pages.sparkSession
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict").alias("held"))
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()
    url = whole(pages[url_col])
    rows = pages.select(pages[id_col].cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("row", F.monotonically_increasing_id())
    if not shape.n:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.size(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), labels), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(shape.lengths)]), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: _key(s, F.substring(F.col("path"), F.lit(1), n)))))
    tried = rows.select("row", "id", "host", "path", F.posexplode_outer(F.when(F.col("host") != "", keys)).alias("at", "key"))
    bloom = share(spark, built(listed.select(F.xxhash64("key").alias("h")), shape.n))

    @F.pandas_udf("boolean")
    def may_hold(h: pd.Series) -> pd.Series:
        return pd.Series(opened(bloom).may_hold(h.to_numpy(dtype=np.int64)))

    tried = tried.withColumn("maybe", may_hold(F.xxhash64("key")))
    # A row's first key stays whatever the filter says, so that no row is lost.
    possible = tried.where(F.col("maybe") | (F.coalesce("at", F.lit(0)) == 0)).withColumn("key", F.when(F.col("maybe"), F.col("key")))
    found = possible.join(listed.select("key", "held"), "key", "left")
    best = found.groupBy("row", "id", "host", "path").agg(F.max("held").alias("held"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("held.rule").alias("rule"), F.coalesce("held.verdict", F.lit(default)).alias("verdict"))
