"""Interleaved documents: ordered text and media references from HTML, digest joins to
the payloads, positions and captions kept in line.

Media are content-addressed: the digest of the stored form is the reference, so equal
media are one entry. The stored form here is an 8-bit greyscale PNG, which holds any bytes
losslessly as samples.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Samples in a row, and the unit that payloads are padded to (24 rows of 24 samples).
WIDTH, UNIT, PAD = 24, 576, b"\xff"
#: Rows encoded at once.
ROWS = 500

SEQUENCE = "array<struct<position: int, kind: string, text: string, media: string, caption: string>>"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit greyscale PNG whose samples are the payload (a multiple of ``width``)."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, width)
    filtered = np.zeros((len(lines), width + 1), np.uint8)  # filter 0 before each line
    filtered[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG with filters 0 (none), 1 (left) or 2 (up)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, width, height = 8, [], 0, 0
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("chunk checksum differs")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    samples = lines[:, 1:].copy()
    for k in np.flatnonzero(lines[:, 0]):
        if lines[k, 0] == 1:
            samples[k] = np.cumsum(samples[k], dtype=np.uint8)
        elif lines[k, 0] == 2:
            samples[k] += samples[k - 1] if k else 0
        else:
            raise ValueError("unsupported filter")
    return samples


def features(samples: np.ndarray) -> str:
    """Shape, mean, deviation and a 64-bit difference hash of the image's 8 x 9 means."""
    rows = np.linspace(0, samples.shape[0], 9).astype(int)
    cols = np.linspace(0, samples.shape[1], 10).astype(int)
    cells = np.add.reduceat(np.add.reduceat(samples.astype(np.int64), rows[:-1], axis=0), cols[:-1], axis=1)
    cells = cells / np.outer(np.maximum(1, np.diff(rows)), np.diff(cols))
    bits = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    return f"{samples.shape[1]}x{samples.shape[0]} mean={samples.mean():.4f} std={samples.std():.4f} dhash={bits}"


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol section article figure figcaption blockquote table tr td th br hr header footer nav main body html head title".split())
_MEDIA = frozenset("img video audio source picture".split())


def interleaved(page: str) -> list[dict]:
    """Text blocks and media references of a page in order. A media reference is its
    ``src``; its caption is its figure's figcaption, else its alternative text."""
    out: list[dict] = []
    parts: list[str] = []
    figure: list[dict] | None = None
    in_caption, at = False, 0

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if not text:
            return
        if in_caption and figure is not None:
            for m in figure:
                m["caption"] = text
        else:
            out.append({"kind": "text", "text": text, "media": None, "caption": None})

    for m in _TAG.finditer(page):
        parts.append(page[at : m.start()])
        at = m.end()
        tag, closing = (m[3] or "").lower(), bool(m[2])
        if tag in _BREAKS or tag in _MEDIA:
            close()
        if tag == "figure":
            figure = None if closing else []
        elif tag == "figcaption":
            in_caption = not closing
        elif tag in _MEDIA and not closing:
            named = {k.lower(): unescape(a or b) for k, a, b in _ATTR.findall(m[4])}
            if named.get("src"):
                out.append({"kind": "media", "text": None, "media": named["src"], "caption": named.get("alt") or None})
                if figure is not None:
                    figure.append(out[-1])
    parts.append(page[at:])
    close()
    return [{"position": k} | x for k, x in enumerate(out)]


def parse(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, sequence): each page's ordered structs; null or empty html has none."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([interleaved(h) for h in batch.column(1).to_pylist()], kind)], names=[id_col, "sequence"])

    return pages.select(pages[id_col].cast("long").alias(id_col), common.whole(pages[html_col]).alias("html")).mapInArrow(run, f"{id_col} long, sequence {SEQUENCE}")


def resolve(sequences: DataFrame, media: DataFrame, id_col: str, prefix: str = "sha256:") -> DataFrame:
    """One row per element, in ``position``; media elements with the columns of ``media``
    (key ``digest``, at most one row per digest), null for text and for digests unknown.

    The element side holds references only; a digest that a third of all elements name is
    a skewed key of short rows, which adaptive execution splits."""
    flat = sequences.select(id_col, F.explode("sequence").alias("e")).select(id_col, "e.*")
    digest = F.when(F.col("media").startswith(prefix), F.substring("media", len(prefix) + 1, 64))
    return flat.withColumn("ref", digest).join(media.withColumnRenamed("digest", "ref"), "ref", "left").withColumnRenamed("ref", "digest")


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + PAD * (-len(data) % unit if data else unit)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, html, digest, media): every whole text as a PNG of its padded bytes,
    and a page that shows the image by its digest with a caption."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, ROWS):
            out: dict[str, list] = {"n_bytes": [], "html": [], "digest": [], "media": []}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                png = to_png(padded(data))
                digest = sha256(png).hexdigest()
                out["n_bytes"].append(len(data))
                out["html"].append(f'<article><h1>Document {i}</h1><figure><img src="sha256:{digest}" alt="samples"><figcaption>{len(data)} bytes</figcaption></figure></article>')
                out["digest"].append(digest)
                out["media"].append(png)
            types = {"n_bytes": pa.int64(), "media": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, types.get(k, pa.string())) for k, v in out.items())], names=[id_col, *out])

    picked = docs.select(docs[id_col].cast("long").alias(id_col), common.whole(docs[text_col]).alias("text"))
    return common.spread(picked).mapInArrow(run, f"{id_col} long, n_bytes long, html string, digest string, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature) of stored media, one row per digest; a file that isn't what its digest says
    fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_batches(batches, ROWS):
            out: dict[str, list] = {k: [] for k in ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for digest, png in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = sha256(png).hexdigest()
                if found != digest:
                    raise ValueError(f"stored media {digest} has digest {found}")
                samples = from_png(png)
                payload = samples.tobytes()
                for k, v in zip(out, (digest, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), found, features(samples)), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for k, v in out.items()], names=list(out))

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text stored as media, shown by a page, parsed back to a sequence and
    resolved by digest: one row per document with its media element's figures.

    A null text is an empty one (576 bytes of padding). Payloads are stored once and read
    back where they lie; the digest join moves references and figures only. Very long texts
    are stored whole; repeated rows give repeated results, an empty table none; other
    columns are ignored, whatever they are called."""
    kept = common.stored(store(docs, id_col, text_col), "media")
    elements = resolve(parse(kept, id_col, "html"), read_back(kept), id_col).where("kind = 'media'")
    return elements.select(id_col, F.regexp_extract("caption", r"^(\d+) bytes", 1).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
