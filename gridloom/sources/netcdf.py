"""Image files of the classic array format (CDF-1, 2 and 5) as a Spark data source, read by ranges.

``spark.read.format("gridnc").schema("rel_path string, wmo_wind double").load(root)``: ``rel_path`` is the file's place
below the root, a column of an array type is the variable of that name in row-major order, ``<name>_shape`` its
lengths, and any other column the global attribute of that name. Only what the schema asks for is read: the header
alone if it has no variable, and of a variable its own bytes. Files are dealt over partitions by their sizes.

Attributes that a file lacks are null, and so are its variables. Values are unpacked as the format's conventions say:
``_FillValue`` and ``missing_value`` become NaN, then ``scale_factor`` and ``add_offset`` apply. A file that doesn't begin
as the format does, or ends before its data, is an error that names it; ``option("bad", "skip")`` leaves it out.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.functions.scalar import relative_path

DEFAULT = "rel_path string, wmo_wind double, bt array<float>"
FIRST_READ, PARTITION_BYTES, BATCH_BYTES = 4096, 32 << 20, 8 << 20
# The format's type numbers.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12

Read = Callable[[int, int], bytes]  # offset and length to bytes


class NotClassic(ValueError):
    """The bytes aren't a whole file of the format."""


@dataclass
class Variable:
    shape: tuple[int, ...]
    kind: np.dtype
    attributes: dict[str, Any]
    begin: int
    record: bool  # its first dimension is the unlimited one


@dataclass
class Header:
    attributes: dict[str, Any]
    variables: dict[str, Variable]
    record_bytes: int
    records: int = field(default=0)


class _Short(Exception):
    """The header goes on beyond the bytes read so far."""


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at, self.wide, self.far = data, 0, False, False

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise _Short(self.at + n)
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, wide: bool) -> int:
        return struct.unpack(">q" if wide else ">i", self.take(8 if wide else 4))[0]

    def count(self) -> int:
        return self.number(self.wide)

    def name(self) -> str:
        n = self.count()
        return self.padded(n).decode("utf-8")

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        self.take(-n % 4)
        return out

    def listed(self, tag: int) -> range:
        found, n = self.number(False), self.count()
        if found not in (0, tag) or n < 0 or (found == 0 and n):
            raise NotClassic("a list has another tag")
        return range(n)

    def attributes(self) -> dict[str, Any]:
        out = {}
        for _ in self.listed(ATTRIBUTE):
            name, kind, n = self.name(), self.number(False), self.count()
            if kind not in TYPES:
                raise NotClassic(f"type {kind}")
            raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, TYPES[kind])
        return out


def parse_header(data: bytes) -> Header:
    """The header of a file that begins with ``data``; _Short if it goes on."""
    if data[:3] != b"CDF"[: len(data)] or (len(data) > 3 and data[3] not in (1, 2, 5)):
        raise NotClassic("no such magic bytes")
    c = _Cursor(data)
    version = c.take(4)[3]
    c.wide, c.far = version == 5, version != 1
    records = c.count()
    dims = []
    for _ in c.listed(DIMENSION):
        c.name()
        dims.append(c.count())
    attributes, variables, sizes = c.attributes(), {}, []
    for _ in c.listed(VARIABLE):
        name = c.name()
        places = [c.count() for _ in range(c.count())]
        own, kind, _, begin = c.attributes(), c.number(False), c.count(), c.number(c.far)
        if kind not in TYPES or any(not 0 <= p < len(dims) for p in places):
            raise NotClassic(f"variable {name}")
        record = bool(places) and dims[places[0]] == 0
        lengths = tuple(dims[p] for p in places)
        variables[name] = Variable(lengths, np.dtype(TYPES[kind]), own, begin, record)
        if record:
            sizes.append(int(np.prod(lengths[1:], dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize)
    # records of all variables alternate, each padded to four bytes unless it is the only one
    record_bytes = sizes[0] if len(sizes) == 1 else sum(s + -s % 4 for s in sizes)
    return Header(attributes, variables, record_bytes, records)


def read_header(read: Read, size: int) -> Header:
    """The header by reads of growing length from the start of a file of ``size`` bytes."""
    data, want = b"", FIRST_READ
    while True:
        data += read(len(data), min(want, size) - len(data))
        try:
            header = parse_header(data)
        except _Short as e:
            if len(data) >= size:
                raise NotClassic("it ends within the header") from None
            want = max(2 * want, int(e.args[0]))
            continue
        if header.records < 0:  # written as a stream: as many records as there are bytes for
            first = min((v.begin for v in header.variables.values() if v.record), default=size)
            header.records = (size - first) // max(header.record_bytes, 1)
        return header


def _number(attributes: dict[str, Any], name: str) -> float | None:
    value = attributes.get(name)
    return float(value[0]) if isinstance(value, np.ndarray) and value.size else None


def read_variable(read: Read, header: Header, name: str) -> tuple[np.ndarray, tuple[int, ...]] | None:
    """A variable's values, unpacked, and its lengths; None if there is none of the name."""
    v = header.variables.get(name)
    if v is None:
        return None
    shape = (header.records, *v.shape[1:]) if v.record else v.shape
    if v.record:
        one = int(np.prod(v.shape[1:], dtype=np.int64)) * v.kind.itemsize
        raw = b"".join(read(v.begin + r * header.record_bytes, one) for r in range(header.records))
    else:
        raw = read(v.begin, int(np.prod(shape, dtype=np.int64)) * v.kind.itemsize)
    if len(raw) != int(np.prod(shape, dtype=np.int64)) * v.kind.itemsize:
        raise NotClassic(f"it ends within {name}")
    packed = np.frombuffer(raw, v.kind)
    if v.kind.kind == "S":
        raise NotClassic(f"{name} is text")
    values = packed.astype(float)
    for mark in ("_FillValue", "missing_value"):
        if (hole := v.attributes.get(mark)) is not None and isinstance(hole, np.ndarray):
            values[np.isin(packed, hole.astype(v.kind))] = np.nan
    scale, offset = _number(v.attributes, "scale_factor"), _number(v.attributes, "add_offset")
    if scale is not None or offset is not None:
        values = values * (1.0 if scale is None else scale) + (offset or 0.0)
    return values, shape


def columns_of(read: Read, size: int, fields: list[T.StructField]) -> dict[str, Any]:
    """The asked columns of one file, without rel_path."""
    header, out, seen = read_header(read, size), {}, {}
    for f in fields:
        base = f.name.removesuffix("_shape")
        is_shape = f.name.endswith("_shape") and isinstance(f.dataType, T.ArrayType)
        if is_shape or isinstance(f.dataType, T.ArrayType):
            key = base if is_shape else f.name
            if is_shape and key in header.variables:
                v = header.variables[key]
                out[f.name] = list((header.records, *v.shape[1:]) if v.record else v.shape)
                continue
            if key not in seen:
                seen[key] = read_variable(read, header, key)
            out[f.name] = None if seen[key] is None else seen[key][0]
        elif f.name != "rel_path":
            value = header.attributes.get(f.name)
            if isinstance(value, np.ndarray):
                value = value.item() if value.size == 1 else None
            text = isinstance(f.dataType, T.StringType)
            out[f.name] = None if value is None or (isinstance(value, str) and not text) else str(value) if text else value
    return out


def encode(attributes: dict[str, Any], variables: dict[str, tuple[np.ndarray, tuple[int, ...]]], version: int = 2) -> bytes:
    """A whole file: global attributes (numbers or text) and variables of floats with dimensions of their own."""
    wide = version == 5
    count = lambda n: struct.pack(">q" if wide else ">i", n)
    name = lambda s: count(len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    listed = lambda tag, parts: struct.pack(">i", tag if parts else 0) + count(len(parts)) + b"".join(parts)

    def attribute(key: str, value: Any) -> bytes:
        raw, kind, n = (value.encode(), 2, len(value.encode())) if isinstance(value, str) else (struct.pack(">d", value), 6, 1)
        return name(key) + struct.pack(">i", kind) + count(n) + raw + b"\0" * (-len(raw) % 4)

    dims = [name(f"{v}_{i}") + count(n) for v, (_, shape) in variables.items() for i, n in enumerate(shape)]
    head = b"CDF" + bytes([version]) + count(0) + listed(DIMENSION, dims) + listed(ATTRIBUTE, [attribute(k, v) for k, v in attributes.items()])
    bodies = [np.asarray(x, ">f4").tobytes() for x, _ in variables.values()]

    def described(begins: list[int]) -> bytes:
        out, at = [], 0
        for (v, (_, shape)), body, begin in zip(variables.items(), bodies, begins):
            places = b"".join(count(at + i) for i in range(len(shape)))
            out.append(name(v) + count(len(shape)) + places + listed(ATTRIBUTE, []) + struct.pack(">i", 5) + count(len(body)) + struct.pack(">i" if version == 1 else ">q", begin))
            at += len(shape)
        return listed(VARIABLE, out)

    start = len(head) + len(described([0] * len(bodies)))
    begins = [start + sum(map(len, bodies[:i])) for i in range(len(bodies))]
    return head + described(begins) + b"".join(bodies)


def _store(root: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]  # below the root, with their sizes


def dealt(files: list[tuple[str, int]], each: Callable[[int], int], limit: int = PARTITION_BYTES) -> list[Files]:
    """Files in order of names, cut into partitions of about ``limit`` bytes to read (``each`` of a file's size)."""
    out, held, total = [], [], 0
    for name, size in sorted(files):
        held.append((name, size))
        total += each(size)
        if total >= limit:
            out.append(Files(held))
            held, total = [], 0
    return [*out, Files(held)] if held or not out else out


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.root = schema, options["path"].rstrip("/")
        self.pattern, self.skip, self.limit = options.get("pattern", "*.nc"), options.get("bad", "fail") == "skip", int(options.get("partitionbytes", PARTITION_BYTES))
        if options.get("bad", "fail") not in ("fail", "skip"):
            raise ValueError("bad: fail or skip")
        self.data = any(isinstance(f.dataType, T.ArrayType) and not f.name.endswith("_shape") for f in schema.fields)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = _store(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(i.path.removeprefix(root).lstrip("/"), i.size) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern)]
        if not files:
            raise FileNotFoundError(f"no {self.pattern} below {self.root}")
        return dealt(files, lambda size: size if self.data else min(size, FIRST_READ), self.limit)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, root = _store(self.root)
        schema, fields = to_arrow_schema(self.schema), self.schema.fields
        rows, held = [], 0
        for name, size in partition.names:
            with store.open_input_file(f"{root}/{name}") as file:
                try:
                    rows.append({"rel_path": name, **columns_of(lambda at, n: bytes(file.read_at(n, at)), size, fields)})
                except NotClassic as e:
                    if self.skip:
                        continue
                    raise ValueError(f"{self.root}/{name}: {e}") from e
            held += size if self.data else FIRST_READ
            if held >= BATCH_BYTES:
                yield self._batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


class _Writer(DataSourceWriter):
    """A file a row, at its rel_path: written again by a retried task, with the same bytes."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        if "rel_path" not in schema.names:
            raise ValueError("rel_path is missing")
        self.schema, self.root, self.version, self.overwrite = schema, options["path"].rstrip("/"), int(options.get("version", 2)), overwrite
        if self.version not in (1, 2, 5):
            raise ValueError("version: 1, 2 or 5")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _store(self.root)
        made: set[str] = set()
        arrays = [f.name for f in self.schema.fields if isinstance(f.dataType, T.ArrayType) and not f.name.endswith("_shape")]
        plain = [f.name for f in self.schema.fields if not isinstance(f.dataType, T.ArrayType) and f.name != "rel_path"]
        for row in iterator:
            attributes = {n: row[n] if isinstance(row[n], str) else float(row[n]) for n in plain if row[n] is not None}
            shape = lambda n: tuple(row[f"{n}_shape"]) if f"{n}_shape" in self.schema.names else (len(row[n]),)
            body = encode(attributes, {n: (np.array(row[n], float), shape(n)) for n in arrays if row[n] is not None}, self.version)
            path = f"{root}/{row['rel_path']}"
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(path) as out:
                out.write(body)
        return WriterCommitMessage()


class GridFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridnc"

    def schema(self) -> str:
        return DEFAULT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridFiles)


def read_files(spark: SparkSession, root: str, schema: str = DEFAULT, pattern: str = "*.nc", bad: str = "fail") -> DataFrame:
    """The files below ``root``. A store that only Spark's own readers open (no such scheme in Arrow) goes through them:
    whole files, but the same columns."""
    try:
        _store(root)
    except (pa.ArrowInvalid, OSError):
        return _whole_files(spark, root, schema, pattern, bad)
    register(spark)
    return spark.read.format("gridnc").schema(schema).option("pattern", pattern).option("bad", bad).load(root)


def _whole_files(spark: SparkSession, root: str, schema: str, pattern: str, bad: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = raw.select(relative_path("path", root).alias("rel_path"), "content")
    asked = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content in zip(batch.column("rel_path").to_pylist(), batch.column("content")):
                data = content.as_py()
                try:
                    out.append({"rel_path": name, **columns_of(lambda at, n: data[at : at + n], len(data), asked.fields)})
                except NotClassic as e:
                    if bad != "skip":
                        raise ValueError(f"{root}/{name}: {e}") from e
            yield _Reader._batch(out, to_arrow_schema(asked))

    return rows.mapInArrow(run, asked)
