"""WARC archives: writing with segmentation and revisits, reading with reassembly.

Archives hold gzip members of one record each. Spark keeps them as rows of a table (one
row per stretch of an archive), so its committer decides which of a task's attempts
counts; ``parse_files`` reads ordinary ``.warc`` and ``.warc.gz`` files as well.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stored, whole

#: Bytes of a block after which it goes on in continuation records; of an HTTP chunk;
#: of archive in a row of the archive table.
SEGMENT, CHUNK, STRETCH = 16_384, 4096, 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

RECORD = "record_id string, kind string, page_id long, uri string, refers_to string, digest string, origin string, segment int, total long, payload_bytes long, payload_digest string, complete boolean, block binary, payload binary"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    at, parts = 0, []
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(parts)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The entity of an HTTP response block, without chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _urn(name: bytes) -> str:
    h = sha1(name).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    named = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": "2024-01-01T00:00:00Z"} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None} | {"Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def segmented(record_id: str, block: bytes, size: int, **fields: object) -> Iterator[bytes]:
    """A response record, followed by continuation records where its block is long."""
    if len(block) <= size:
        yield record("response", record_id, block, **fields)
        return
    parts = [block[i : i + size] for i in range(0, len(block), size)]
    yield record("response", record_id, parts[0], WARC_Segment_Number=1, **fields)
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield record("continuation", _urn(f"{record_id}{k}".encode()), part, WARC_Segment_Origin_ID=record_id, WARC_Segment_Number=k, WARC_Segment_Total_Length=total)


def members(data: bytes) -> Iterator[bytes]:
    """The records of a stretch of archive, gzipped one by one or plain."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            inflate, parts = zlib.decompressobj(31), []
            while not inflate.eof and at < len(data):
                fed = data[at : at + 16_384]
                parts.append(inflate.decompress(fed))
                at += len(fed) - len(inflate.unused_data)
            yield from members(b"".join(parts))
        else:
            head = data.find(b"\r\n\r\n", at)
            if head < 0:
                return
            n = next((int(x[15:]) for x in data[at:head].split(b"\r\n") if x[:15].lower() == b"content-length:"), 0)
            yield data[at : head + 4 + n]
            at = head + 8 + n


def parsed(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return {"block": block} | named


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT) -> DataFrame:
    """(archive, stretch, content) rows of the written archives, one record per page.

    Of equal payloads the one with the largest id is the response and the others revisit
    it. Digests are grouped with partial counts and decisions are joined by id, so a
    payload that many pages share moves as short rows only. Null html is an empty payload,
    null ids come before all others. Of rows of equal id and payload one, with the least
    URL, is the response: equal rows have no name of their own, so they are counted, and
    one response and the other revisits are written from the counts."""
    rows = pages.select(pages[id_col].cast("long").alias("id"), whole(pages[url_col]).alias("uri"), whole(pages[html_col]).cast("binary").alias("html")).withColumn("sha", F.sha1("html"))
    copies = rows.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("copies"))
    firsts = copies.groupBy("sha").agg(F.max(F.coalesce("id", F.lit(-(2**63)))).alias("top"))
    decided = stored(copies.join(firsts, "sha").select("id", "sha", "copies", (F.coalesce("id", F.lit(-(2**63))) == F.col("top")).alias("first")), "decided")
    joined = rows.alias("r").join(decided.alias("d"), F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.sha") == F.col("d.sha"))).select("r.id", "uri", "html", F.col("r.sha").alias("sha"), "first", "copies")
    repeats = F.col("first") & (F.col("copies") > 1)
    if not decided.where(repeats).isEmpty():
        same = joined.where(repeats)
        counts = stored(same.groupBy("id", "sha", "uri").agg(F.count(F.lit(1)).alias("n")), "counts")
        least = counts.groupBy("id", "sha").agg(F.min("uri").alias("least"))
        others = counts.alias("c").join(least.alias("l"), F.col("c.id").eqNullSafe(F.col("l.id")) & (F.col("c.sha") == F.col("l.sha"))).withColumn("others", F.col("n") - (F.col("uri") == F.col("least")).cast("long")).where("others > 0")
        revisits = others.select("c.id", "uri", F.lit(b"").alias("html"), F.col("c.sha").alias("sha"), F.lit(False).alias("first"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("others"))).alias("copies"))
        response = same.groupBy("id", "sha").agg(F.min("uri").alias("uri"), F.first("html").alias("html")).select("id", "uri", "html", "sha", F.lit(True).alias("first"), F.lit(1).cast("long").alias("copies"))
        joined = joined.where(~repeats).unionByName(response).unionByName(revisits)
    joined = joined.drop("copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, stretch, size, parts, row = TaskContext.get().partitionId(), 0, 0, [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": pa.array([f"part-{task:06d}.warc.gz"]), "stretch": pa.array([stretch], pa.int32()), "content": pa.array([b"".join(parts)], pa.binary())})

        for batch in in_batches(batches, 500):
            for i, uri, html, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row += 1
                digest = bytes.fromhex(sha)
                answer = _urn(digest)  # a payload has one response
                named = {"WARC_Target_URI": " ".join(uri.split()) or None, "WARC_Payload_Digest": f"sha1:{b32(digest)}", "WARC_Page_ID": i, "Content_Type": "application/http; msgtype=response"}
                if first:
                    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(html)
                    made = segmented(answer, block, segment, **named)
                else:
                    made = [record("revisit", _urn(b"%d/%d/%b" % (task, row, digest)), HEAD + b"\r\n", WARC_Profile=PROFILE, WARC_Refers_To=answer, **named)]
                for r in made:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    parts.append(z.compress(r) + z.flush())
                    size += len(parts[-1])
                if size >= STRETCH:
                    yield flushed()
                    stretch, size, parts = stretch + 1, 0, []
        if parts:
            yield flushed()

    return joined.mapInArrow(run, "archive string, stretch int, content binary")


def parse_files(spark, path: str) -> DataFrame:
    """(archive, stretch, content) of WARC files at any path that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.lit(0).alias("stretch"), "content")


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The logical records of archives: one row per response or revisit.

    Continuation records are grouped by their origin's identifier, ordered by segment
    number and joined; ``complete`` says whether the numbers have no gap, the length is the
    total that the last segment states and the framing decodes (if not, the payload columns
    are null). Only segmented records are shuffled with their blocks, each a group of its
    own, whose size is one record's."""

    def rows(found: list[dict]) -> pa.RecordBatch:
        schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_()), ("block", pa.binary()), ("payload", pa.binary())])
        return pa.RecordBatch.from_pylist(found, schema=schema)

    def measured(block: bytes) -> dict:
        try:
            payload = payload_of(block)
        except ValueError:
            return {"complete": False}
        return {"complete": True, "payload_bytes": len(payload), "payload_digest": b32(sha1(payload).digest())} | ({"payload": payload} if with_payload else {})

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 1):
            found = []
            for data in members(batch.column(0)[0].as_py() or b""):
                r = parsed(data)
                kind, number = r.get("warc-type"), r.get("warc-segment-number")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                page = r.get("warc-page-id")
                out = {"record_id": r["warc-record-id"], "kind": kind, "page_id": int(page) if page else None, "uri": r.get("warc-target-uri"), "refers_to": r.get("warc-refers-to"), "digest": (r.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "origin": r.get("warc-segment-origin-id") or r["warc-record-id"]}
                if number:
                    total = r.get("warc-segment-total-length")
                    out |= {"segment": int(number), "total": int(total) if total else None, "block": r["block"]}
                elif kind == "response":
                    out |= measured(r["block"])
                else:
                    out["complete"] = True
                found.append(out)
            yield rows(found)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 200):
            found = []
            for r in batch.to_pylist():
                parts = r.pop("parts")
                if parts:
                    block = b"".join(p["block"] for p in parts)
                    whole_one = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
                    r |= measured(block) if whole_one else {"complete": False}
                found.append(r)
            yield rows(found)

    single = ("record_id", "kind", "page_id", "uri", "refers_to", "digest", "payload_bytes", "payload_digest", "complete", "payload")
    read = archives.select("content").mapInArrow(parse, RECORD)
    named = F.col("kind") != "continuation"
    grouped = read.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "total", "block")))).alias("parts"),
        *[F.first(F.when(named, F.col(c)), ignorenulls=True).alias(c) for c in single],
    )
    return grouped.select(*single, "parts").mapInArrow(reassemble, RECORD).select(*single)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page to archives, read them back and resolve the revisits: per page its
    full payload's size and digest, its record type and the page that it refers to."""
    archives = stored(write_archives(pages, id_col, url_col, html_col), "archives")
    records = stored(read_records(archives, with_payload=False), "records")
    answers = records.where("kind = 'response'").select(F.col("record_id").alias("answer"), F.col("page_id").alias("answer_page"), F.col("payload_bytes").alias("answer_bytes"))
    resolved = records.join(answers, (F.col("kind") == "revisit") & (F.col("refers_to") == F.col("answer")), "left")
    return resolved.select(
        F.col("page_id").alias(id_col),
        F.coalesce("payload_bytes", "answer_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", F.col("answer_page")).alias("refers_to"),
        "complete",
    )
