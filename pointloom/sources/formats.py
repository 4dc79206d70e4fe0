"""PLY and LAS as Spark data sources: ``spark.read.format("las")``, ``df.write.format("ply")``.

Reading splits files: a partition is a run of records, found from the header's record length
(in text files a run of bytes, whose lines belong to the run in which they start), and only
the columns of the asked schema are decoded. Simple comparisons are pushed down: they drop
rows before they become columns, runs by record number, and whole LAS files by the bounds in
their header.

Writing is done by tasks through Spark's commit protocol: a task writes whole files with
headers of their own into a temporary folder, the commit moves the files of the attempts that
Spark accepted, and an abort leaves nothing. :func:`merged` makes one file of a folder: tasks
copy the records to their places in it.

Paths may lie in any file system that pyarrow opens (local, S3, HDFS, GCS ...).
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from fnmatch import translate
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a run, records that are decoded at once, records of a written file.
RUN_BYTES, ROWS, FILE_ROWS = 64 << 20, 100_000, 500_000
# PLY scalar types and their numpy forms.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
# Byte offsets of red in the LAS point formats that have colours, base sizes.
LAS_RED = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
LAS_SIZE = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
# Numpy forms of the LAS extra-bytes data types 1 to 10.
LAS_EXTRA = ("u1", "i1", "u2", "i2", "u4", "i4", "u8", "i8", "f4", "f8")
#: Names of colour columns and of the PLY properties they are read from and written to.
SHADES = {"r": "red", "g": "green", "b": "blue"}

# Files


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what makes that path a URI again)."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    scheme, _, rest = path.rpartition("://")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(rest), "file://"
    host, _, inside = rest.partition("/")
    system, _ = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    if scheme in ("hdfs", "viewfs"):
        return system, f"/{inside}", f"{scheme}://{host}"
    return system, rest, f"{scheme}://"


def listed(path: str, suffix: str) -> list[str]:
    """The URIs of a file, of a folder's files with the suffix (hidden ones aside), or of the
    files that match a pattern, in order."""
    system, at, prefix = located(path)
    if re.search(r"[*?\[]", at):
        base = at[: re.search(r"[*?\[]", at).start()].rpartition("/")[0] or "/"
        parts = at.split("/")
        rule = [re.compile(translate(p)) for p in parts]
        found = [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and len(f.path.split("/")) == len(parts) and all(r.match(p) for r, p in zip(rule, f.path.split("/"), strict=True))]
    else:
        kind = system.get_file_info(at)
        if kind.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [at] if kind.type == fs.FileType.File else [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.path.lower().endswith(suffix) and PurePosixPath(f.path).name[0] not in "._"]
    return [prefix + f for f in sorted(found)]


def opened(uri: str) -> pa.NativeFile:
    system, at, _ = located(uri)
    return system.open_input_file(at)


@dataclass
class Layout:
    """Where a file's records lie and what they hold: ``fields`` maps a column to (numpy form,
    byte in the record, factor, divisor, summand); ``ends`` to its (least, greatest) value if known. A
    ``length`` of 0 stands for lines of text, whose fields are numbered."""

    start: int
    length: int
    count: int
    fields: dict[str, tuple[str, int, float, float, float]]
    ends: dict[str, tuple[float, float]] = field(default_factory=dict)


def ply_layout(read: Callable[[int, int], bytes], size: int) -> Layout:
    """The layout of a PLY file from ``read(bytes, at)``. Elements before the vertices must
    have records of one length; a vertex has no lists."""
    head, at = b"", 0
    while b"end_header" not in head or b"\n" not in head[head.index(b"end_header") :]:
        if at >= size or at > 1 << 24:
            raise ValueError("not a PLY file")
        part = read(min(1 << 16, size - at), at)
        head, at = head + part, at + len(part)
    end = head.index(b"\n", head.index(b"end_header")) + 1
    lines = [w for w in (line.split() for line in head[:end].decode("ascii", "replace").splitlines()) if w]
    if lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    form, elements = "ascii", []
    for w in lines[1:]:
        if w[0] == "format":
            form = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property":
            elements[-1][2].append((w[-1], None if w[1] == "list" else PLY_TYPES[w[1]]))
    start, order = end, ">" if form == "binary_big_endian" else "<"
    for name, count, held in elements:
        if name != "vertex":
            if form == "ascii" or any(t is None for _, t in held):
                raise ValueError("elements before the vertices need records of one length")
            start += count * sum(int(t[1]) for _, t in held)
            continue
        if any(t is None for _, t in held):
            raise ValueError("a vertex with a list")
        fields, place = {}, 0
        for k, (column, t) in enumerate(held):
            fields[column] = (t if form == "ascii" else order + t, k if form == "ascii" else place, 1.0, 1.0, 0.0)
            place += int(t[1])
        for column, shade in SHADES.items():
            if shade in fields:
                t = fields[shade][0].lstrip("<>")
                fields[column] = (*fields[shade][:2], 1.0, 256.0 ** int(t[1]) - 1 if t[0] == "u" else 1.0, 0.0)
        return Layout(start, 0 if form == "ascii" else place, count, fields)
    raise ValueError("a PLY file without vertices")


def las_layout(read: Callable[[int, int], bytes], size: int, keep_offset: bool = False) -> Layout:
    """The layout of a LAS 1.2 to 1.4 file, extra dimensions included. Offsets are dropped
    unless asked for, so coordinates are local."""
    data = read(min(size, 375), 0)
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, header = data[25], struct.unpack_from("<H", data, 94)[0]
    start, records, form, length, count = struct.unpack_from("<IIBHI", data, 96)
    form &= 0x3F
    if minor >= 4 and struct.unpack_from("<Q", data, 247)[0]:
        count = struct.unpack_from("<Q", data, 247)[0]
    scale, shift, span = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155), struct.unpack_from("<6d", data, 179)
    moved = shift if keep_offset else (0.0, 0.0, 0.0)
    fields = {c: ("<i4", 4 * k, scale[k], 1.0, moved[k]) for k, c in enumerate("xyz")}
    fields["intensity"] = ("<u2", 12, 1.0, 1.0, 0.0)
    fields["classification"] = ("u1", 16 if form >= 6 else 15, 1.0, 1.0, 0.0)
    if form in LAS_RED:
        fields |= {c: ("<u2", LAS_RED[form] + 2 * k, 1.0, 1.0, 0.0) for k, c in enumerate(SHADES.values())}
    data = read(start, 0)
    at, place = header, LAS_SIZE[form]
    for _ in range(records):
        user, number, taken = data[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", data, at + 18)
        if user == b"LASF_Spec" and number == 4:
            for k in range(at + 54, at + 54 + taken, 192):
                kind, name = data[k + 2], data[k + 4 : k + 36].rstrip(b"\0").decode("ascii", "replace")
                width = np.dtype(LAS_EXTRA[kind - 1]).itemsize if 1 <= kind <= 10 else data[k + 3]
                if 1 <= kind <= 10:
                    factor = struct.unpack_from("<d", data, k + 112)[0] if data[k + 3] & 8 else 1.0
                    summand = struct.unpack_from("<d", data, k + 136)[0] if data[k + 3] & 16 else 0.0
                    fields.setdefault(name, ("<" + LAS_EXTRA[kind - 1], place, factor, 1.0, summand))
                place += width
        at += 54 + taken
    # header bounds lie in whole coordinates; a step of the scale covers their rounding
    ends = {c: (span[2 * k + 1] - shift[k] + moved[k] - scale[k], span[2 * k] - shift[k] + moved[k] + scale[k]) for k, c in enumerate("xyz") if span[2 * k + 1] <= span[2 * k]}
    return Layout(start, length, count, fields, ends)


# Reading


def decoded(layout: Layout, data: bytes, columns: Sequence[str]) -> dict[str, np.ndarray | None]:
    """The asked columns of whole records (None: the file has no such column)."""
    known = [c for c in columns if c in layout.fields]
    forms = {c: layout.fields[c] for c in known}
    kind = np.dtype({"names": known, "formats": [f[0] for f in forms.values()], "offsets": [f[1] for f in forms.values()], "itemsize": layout.length})
    rows = np.frombuffer(data, kind)
    return {c: _valued(rows[c], forms[c]) if c in forms else None for c in columns}


def _valued(raw: np.ndarray, form: tuple[str, int, float, float, float]) -> np.ndarray:
    return raw if form[2:] == (1.0, 1.0, 0.0) else raw * form[2] / form[3] + form[4]


def parsed(layout: Layout, lines: list[bytes], columns: Sequence[str]) -> dict[str, np.ndarray | None]:
    """The same for lines of text."""
    width = 1 + max((f[1] for f in layout.fields.values()), default=0)
    words = b" ".join(lines).split()
    if len(words) != width * len(lines):  # more words in a line than the header names
        words = [w for line in lines for w in line.split()[:width]]
    table = np.array(words, dtype=float).reshape(len(lines), width)
    return {c: _valued(table[:, layout.fields[c][1]], layout.fields[c]) if c in layout.fields else None for c in columns}


def _kept(filters: Sequence[Filter], columns: dict[str, np.ndarray | None], n: int) -> np.ndarray:
    """Rows that no filter rules out; Spark applies the filters again."""
    keep = np.ones(n, bool)
    for f in filters:
        v = columns.get(f.attribute[0])
        if v is None:
            return np.zeros(n, bool)  # a null fails every comparison
        hit = {EqualTo: lambda: v == f.value, GreaterThan: lambda: v > f.value, GreaterThanOrEqual: lambda: v >= f.value, LessThan: lambda: v < f.value, LessThanOrEqual: lambda: v <= f.value, In: lambda: np.isin(v, list(f.value)), IsNotNull: lambda: np.ones(n, bool)}[type(f)]()
        keep &= hit | (v != v)  # noqa: PLR0124  Spark orders NaN last
    return keep


def _outside(f: Filter, low: float, high: float) -> bool:
    """Whether no value from ``low`` to ``high`` passes."""
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return high < f.value
    if isinstance(f, (LessThan, LessThanOrEqual)):
        return low > f.value
    if isinstance(f, EqualTo):
        return not low <= f.value <= high
    return isinstance(f, In) and all(not low <= v <= high for v in f.value)


@dataclass
class Run(InputPartition):
    """Records ``first`` to before ``last`` of a file; of text, the lines that start in those
    bytes after the header, the first of which is record ``base``."""

    uri: str
    layout: Layout
    first: int
    last: int
    base: int = 0


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str], suffix: str, layout_of: Callable):
        self.schema, self.options, self.suffix, self.layout_of = schema, options, suffix, layout_of
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        numbers = {f.name for f in self.schema if f.dataType.typeName() not in ("string", "boolean", "binary")}
        for f in filters:
            value = getattr(f, "value", 0)
            plain = all(isinstance(v, (int, float)) and not isinstance(v, bool) and v == v for v in (value if isinstance(f, In) else [value]))  # noqa: PLR0124
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in numbers and plain:
                self.filters.append(f)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        uris = [u for p in paths for u in listed(p, self.suffix)]
        run_bytes = int(self.options.get("runbytes", RUN_BYTES))
        bases = json.loads(self.options.get("bases", "{}"))

        def of(uri: str) -> list[Run]:
            with opened(uri) as file:
                size = file.size()
                layout = self.layout_of(lambda n, at: file.read_at(n, at), size)
            if any(f.attribute[0] in layout.ends and layout.count and _outside(f, *layout.ends[f.attribute[0]]) for f in self.filters):
                return []
            if layout.length:
                if layout.count * layout.length > size - layout.start:
                    raise ValueError(f"the file is shorter than its header says: {uri}")
                step = max(1, run_bytes // layout.length)
                runs = [Run(uri, layout, a, min(layout.count, a + step), a) for a in range(0, layout.count, step)]
                ids = [f for f in self.filters if f.attribute[0] == "id"]
                return [r for r in runs if not any(_outside(f, r.first, r.last - 1) for f in ids)]
            body = size - layout.start
            if uri not in bases:  # without the lines before each run the file stays whole
                return [Run(uri, layout, 0, body)] if layout.count else []
            return [Run(uri, layout, a, min(body, a + run_bytes), base) for a, base in zip(range(0, body, run_bytes), bases[uri], strict=True) if base < layout.count]

        with ThreadPoolExecutor(32) as pool:
            return [r for runs in pool.map(of, uris) for r in runs] or [Run("", Layout(0, 1, 0, {}), 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        asked = [f.name for f in self.schema]
        used = [c for c in dict.fromkeys([*asked, *(f.attribute[0] for f in self.filters)]) if c not in ("file", "id")]
        for base, columns, n in (self._records if partition.layout.length else self._lines)(partition, used):
            columns["id"] = np.arange(base, base + n)
            keep = _kept(self.filters, columns, n) if self.filters else np.ones(n, bool)
            left = int(keep.sum())
            if left:
                yield self._batch(partition.uri, columns, keep, left)

    def _records(self, run: Run, used: list[str]) -> Iterator[tuple[int, dict, int]]:
        with opened(run.uri) as file:
            for a in range(run.first, run.last, ROWS):
                n = min(ROWS, run.last - a)
                yield a, decoded(run.layout, file.read_at(n * run.layout.length, run.layout.start + a * run.layout.length), used), n

    def _lines(self, run: Run, used: list[str]) -> Iterator[tuple[int, dict, int]]:
        base, held = run.base, []
        for lines in lines_of(run.uri, run.layout, run.first, run.last):
            held += lines[: run.layout.count - base - len(held)]
            while len(held) >= ROWS or held and len(held) == run.layout.count - base:
                some, held = held[:ROWS], held[ROWS:]
                yield base, parsed(run.layout, some, used), len(some)
                base += len(some)
            if base >= run.layout.count:
                return
        if held:
            yield base, parsed(run.layout, held, used), len(held)

    def _batch(self, uri: str, columns: dict, keep: np.ndarray, n: int) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, arrays = to_arrow_schema(self.schema), []
        for f in schema:
            if f.name == "file":
                arrays.append(pa.array([uri] * n, f.type))
                continue
            v = columns.get(f.name)
            arrays.append(pa.nulls(n, f.type) if v is None else pa.array(v[keep].astype(v.dtype.newbyteorder("="))).cast(f.type, safe=False))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lines_of(uri: str, layout: Layout, first: int, last: int, step: int = 1 << 23) -> Iterator[list[bytes]]:
    """The lines that start in bytes ``first`` to before ``last`` after the header."""
    with opened(uri) as file:
        body = file.size() - layout.start
        at, rest = max(0, first - 1), b""
        skip = first > 0  # up to the end of the line before
        while at < body:
            data = file.read_at(min(step, body - at), layout.start + at)
            begin = at - len(rest)  # of the held line
            at += len(data)
            pieces = (rest + data).split(b"\n")
            rest = pieces.pop()
            if skip and pieces:
                begin += len(pieces.pop(0)) + 1
                skip = False
            starts = begin + np.cumsum([0, *(len(p) + 1 for p in pieces)])
            n = int(np.searchsorted(starts[:-1], last, "left"))
            yield pieces[:n]
            if n < len(pieces) or not skip and starts[-1] >= last:
                return
        if rest and not skip:
            yield [rest]


def line_bases(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES) -> dict[str, list[int]]:
    """For every text PLY file of a path the number of lines before each run of bytes: tasks
    count line ends, the driver gets a number per run."""
    runs = []
    for uri in listed(path, ".ply"):
        with opened(uri) as file:
            layout = ply_layout(lambda n, at, f=file: f.read_at(n, at), file.size())
            if not layout.length and file.size() > layout.start:
                runs += [(uri, layout.start, a, min(file.size() - layout.start, a + run_bytes)) for a in range(0, file.size() - layout.start, run_bytes)]
    out: dict[str, list[int]] = {uri: [0] for uri, *_ in runs}
    if len(out) == len(runs):
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, data = 0, b""
                with opened(uri) as file:
                    for at in range(first, last, 1 << 23):
                        data = file.read_at(min(1 << 23, last - at), start + at)
                        n += data.count(b"\n")
                yield pa.RecordBatch.from_pydict({"uri": [uri], "first": [first], "n": [n], "whole": [data.endswith(b"\n")]})

    counted = spark.createDataFrame(runs, "uri string, start long, first long, last long").repartition(min(len(runs), 10_000)).mapInArrow(run, "uri string, first long, n long, whole boolean")
    found = {(r.uri, r.first): r for r in counted.toLocalIterator()}
    ended: dict[str, tuple[int, bool]] = {}
    for uri, _, first, _ in runs:
        if first:
            # lines that start before a run: those that ended, and the one that goes on into it
            n, whole = ended[uri]
            out[uri].append(n + (not whole))
        r = found[uri, first]
        ended[uri] = (ended.get(uri, (0, True))[0] + r.n, r.whole)
    return out


# Writing


def _written(names: list[str]) -> WriterCommitMessage:
    out = WriterCommitMessage()
    out.names = names
    return out


class Writer(DataSourceArrowWriter):
    """Files of at most FILE_ROWS records; ``packed`` makes (header, body) of a table."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool, suffix: str, packed: Callable[[pa.Table, dict[str, str]], tuple[bytes, bytes]]):
        self.schema, self.options, self.overwrite, self.suffix, self.packed = schema, options, overwrite, suffix, packed
        self.folder, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    @property
    def hidden(self) -> str:
        return f"_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, at, _ = located(self.folder)
        system.create_dir(f"{at}/{self.hidden}")
        part, names, held, size = TaskContext.get().partitionId(), [], [], 0

        def flush(rows: pa.Table) -> None:
            name = f"part-{part:06d}-{len(names):05d}-{uuid.uuid4().hex}{self.suffix}"
            with system.open_output_stream(f"{at}/{self.hidden}/{name}") as out:
                for data in self.packed(rows, self.options):
                    out.write(data)
            names.append(name)

        for batch in iterator:
            held.append(batch)
            size += batch.num_rows
            while size >= FILE_ROWS:
                whole = pa.Table.from_batches(held)
                flush(whole.slice(0, FILE_ROWS))
                held, size = whole.slice(FILE_ROWS).to_batches(), size - FILE_ROWS
        if size:
            flush(pa.Table.from_batches(held))
        return _written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at, _ = located(self.folder)
        system.create_dir(at)
        old = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(self.suffix)] if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{at}/{self.hidden}/{name}", f"{at}/{name}")
        for path in old:
            system.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at, _ = located(self.folder)
        if system.get_file_info(f"{at}/{self.hidden}").type != fs.FileType.NotFound:
            system.delete_dir(f"{at}/{self.hidden}")


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    return rows.column(column).to_numpy().astype(float)


def ply_packed(rows: pa.Table, options: dict[str, str]) -> tuple[bytes, bytes]:
    """Header and body: x, y, z and normals as doubles, r, g, b in [0, 1] as bytes (null: 0),
    all other numbers as doubles (null: not a number). ``id`` isn't written: it is the order."""
    shades = [c for c in SHADES if c in rows.column_names]
    others = [f.name for f in rows.schema if f.name not in (*"xyz", "id", "file", *shades) and (pa.types.is_integer(f.type) or pa.types.is_floating(f.type))]
    columns = [(c, "f8", _numbers(rows, c)) for c in "xyz"]
    columns += [(SHADES[c], "u1", np.rint(np.clip(np.nan_to_num(_numbers(rows, c)), 0, 1) * 255)) for c in shades]
    columns += [(c, "f8", _numbers(rows, c)) for c in others]
    form = options.get("form", "binary_little_endian")
    head = ply_header(form, rows.num_rows, [(c, t) for c, t, _ in columns])
    if form == "ascii":
        words = [[repr(x) for x in v.tolist()] if t == "f8" else [str(int(x)) for x in v.tolist()] for _, t, v in columns]
        return head, "".join(" ".join(line) + "\n" for line in zip(*words, strict=True)).encode("ascii")
    body = np.zeros(rows.num_rows, [(c, "<" + t) for c, t, _ in columns])
    for c, _, v in columns:
        body[c] = v
    return head, body.tobytes()


def ply_header(form: str, count: int, properties: list[tuple[str, str]]) -> bytes:
    names = {"f8": "double", "u1": "uchar"}
    return "\n".join(["ply", f"format {form} 1.0", f"element vertex {count}", *(f"property {names[t]} {c}" for c, t in properties), "end_header", ""]).encode("ascii")


#: Records of LAS point format 2.
LAS_RECORD = [*((c, "<i4") for c in "xyz"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), *((c, "<u2") for c in SHADES.values())]


def las_packed(rows: pa.Table, options: dict[str, str]) -> tuple[bytes, bytes]:
    """LAS 1.2 of point format 2: x, y, z at a scale (option ``scale``, 0.001), 16-bit red,
    green, blue, intensity and the class where the rows have them (null: 0), every other
    number as an extra dimension of doubles (null: not a number). Null coordinates, and those
    beyond 32 bits at the scale, are errors. ``id`` isn't written: it is the order."""
    scale = float(options.get("scale", 0.001))
    plain = [c for c in ("intensity", "classification", *SHADES.values()) if c in rows.column_names]
    extra = [f.name for f in rows.schema if f.name not in (*"xyz", "id", "file", *plain) and (pa.types.is_integer(f.type) or pa.types.is_floating(f.type))]
    body = np.zeros(rows.num_rows, [*LAS_RECORD, *((f"+{c}", "<f8") for c in extra)])
    ends = []
    for c in "xyz":
        if rows.column(c).null_count:
            raise ValueError("null coordinates")
        steps = np.rint(_numbers(rows, c) / scale)
        if not (np.abs(steps) < 2**31 - 1).all():
            raise ValueError("coordinates too far out for this scale")
        body[c] = steps
        ends += [float(steps.max(initial=-np.inf)) * scale, float(steps.min(initial=np.inf)) * scale]
    for c in plain:
        body[c] = np.nan_to_num(_numbers(rows, c))
    for c in extra:
        body[f"+{c}"] = _numbers(rows, c)
    return las_header(rows.num_rows, body.dtype.itemsize, scale, ends, extra), body.tobytes()


def las_header(count: int, length: int, scale: float, ends: list[float], extra: Sequence[str]) -> bytes:
    """A LAS 1.2 header with its extra dimensions; ``ends`` are greatest and least x, y, z."""
    if count >= 2**32:
        raise ValueError("too many points for one file")
    notes = b""
    for c in extra:
        notes += struct.pack("<HBB32s", 0, 10, 0, c.encode("ascii", "replace")) + bytes(192 - 36)
    if notes:
        notes = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(notes), b"") + notes
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<IIBHI", head, 96, 227 + len(notes), bool(notes), 2, length, count)
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<6d", head, 179, *(e if count else 0.0 for e in ends))
    return bytes(head) + notes


# Sources


class Ply(DataSource):
    """Options: ``path``; ``runbytes`` (bytes of a partition); for writing ``form`` (ascii or
    binary_little_endian). A schema may name any property."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "file string, id long, " + ", ".join(f"{c} double" for c in ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz"))

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options), ".ply", ply_layout)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, dict(self.options), overwrite, ".ply", ply_packed)


class Las(DataSource):
    """Options: ``path``; ``runbytes``; ``keepoffset`` (true: whole coordinates); ``scale`` for
    writing. A schema may name any dimension, extra ones included."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "file string, id long, x double, y double, z double, classification int, red int, green int, blue int"

    def reader(self, schema: StructType) -> Reader:
        whole = self.options.get("keepoffset", "false").lower() == "true"
        return Reader(schema, dict(self.options), ".las", lambda read, size: las_layout(read, size, whole))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, dict(self.options), overwrite, ".las", las_packed)


def register(spark: SparkSession) -> None:
    """Make the formats ``ply`` and ``las`` known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Ply, Las):
        spark.dataSource.register(source)


def merged(spark: SparkSession, folder: str, target: str) -> None:
    """One file of the written files of a folder, in order of their names. The driver makes the
    header; tasks copy the records to their places, so a task that is tried again writes the
    same bytes, and the file gets its name when it is whole. Needs a file system with writes
    anywhere in a file (local or mounted); elsewhere the folder is the cloud."""
    system, at, _ = located(target)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError("a single file needs a mounted file system; write a folder instead")
    suffix = os.path.splitext(at)[1].lower()
    head, parts, total, count = b"", [], 0, 0
    heads = []
    for uri in listed(folder, suffix):
        with opened(uri) as file:
            layout = (las_layout if suffix == ".las" else ply_layout)(lambda n, p, f=file: f.read_at(n, p), file.size())
            heads.append(file.read_at(layout.start, 0))
            parts.append((uri, layout.start, total, file.size() - layout.start))
            total, count = total + file.size() - layout.start, count + layout.count
    if not heads:
        raise FileNotFoundError(folder)
    if suffix == ".las":
        if count >= 2**32:
            raise ValueError("too many points for one file")
        new = bytearray(heads[0])
        struct.pack_into("<I", new, 107, count)
        spans = [struct.unpack_from("<6d", h, 179) for h, n in zip(heads, parts, strict=True) if n[3]]
        if spans:
            struct.pack_into("<6d", new, 179, *[(max, min)[k % 2](s[k] for s in spans) for k in range(6)])
        head = bytes(new)
    else:
        head = re.sub(rb"element vertex \d+", b"element vertex %d" % count, heads[0])
    os.makedirs(os.path.dirname(at), exist_ok=True)
    made = f"{at}.{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        f.write(head)
        f.truncate(len(head) + total)
    slices = [(uri, start + a, len(head) + to + a, min(RUN_BYTES, size - a)) for uri, start, to, size in parts for a in range(0, size, RUN_BYTES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, to, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(uri) as file, open(made, "r+b") as out:
                    out.seek(to)
                    for a in range(0, size, 1 << 23):
                        out.write(file.read_at(min(1 << 23, size - a), start + a))
                yield pa.RecordBatch.from_pydict({"size": [size]})

    try:
        if slices:
            rows = spark.createDataFrame(slices, "uri string, start long, at long, size long").repartition(min(len(slices), 10_000))
            rows.mapInArrow(run, "size long").write.format("noop").mode("overwrite").save()
        os.replace(made, at)
    finally:
        if os.path.exists(made):
            os.remove(made)


def saved(points: DataFrame, path: str, kind: str, **options: str) -> None:
    """A cloud as one file: its rows in order of ``id``, written by tasks and merged by tasks."""
    spark = points.sparkSession
    register(spark)
    folder = f"{os.path.dirname(located(path)[1])}/_parts-{uuid.uuid4().hex}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = points.repartitionByRange(n, "id").sortWithinPartitions("id").drop("id")
    system = located(path)[0]
    try:
        ordered.write.format(kind).mode("append").options(**options).save(folder)
        if not listed(folder, f".{kind}"):  # an empty cloud is a header
            packed = {"ply": ply_packed, "las": las_packed}[kind]
            none = pa.Table.from_arrays([pa.array([], _arrow(t)) for _, t in ordered.dtypes], names=ordered.columns)
            with system.open_output_stream(f"{folder}/part-0.{kind}") as out:
                out.write(b"".join(packed(none, options)))
        merged(spark, folder, path)
    finally:
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def _arrow(kind: str) -> pa.DataType:
    return pa.int64() if kind in ("int", "bigint", "smallint", "tinyint") else pa.float64() if kind in ("float", "double") else pa.string()
