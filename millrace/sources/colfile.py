"""A compact columnar file format: reader, writer, and a Spark data source for it.

A file is: magic, column blobs, metadata, the metadata's place, end magic.
INT64 blobs are zigzag varints of differences. VARCHAR blobs are zstd of the
length of the offset section, the offsets as varints of differences, and the
bytes. What the offsets mean isn't part of the format: producers store starts,
ends or lengths, so reader and writer are told which.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Fixed values of the format.
MAGIC, END_MAGIC = b"Tomy", b"EndT"
INT64_TAG, VARCHAR_TAG = 1, 2

STARTS, ENDS, LENGTHS = "starts", "ends", "lengths"
SUFFIX = ".column"
FORMAT = "columnfile"


class BadFile(ValueError):
    """The bytes aren't a file of the format, or are cut off."""


def zigzag(n: np.ndarray) -> np.ndarray:
    """Signed to unsigned: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    n = np.asarray(n, np.int64)
    return ((n << 1) ^ (n >> 63)).view(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, np.uint64)
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)


def put_varints(values: np.ndarray) -> bytes:
    """Unsigned numbers, seven bits a byte, least first, the high bit set on all but the last byte."""
    values = np.asarray(values, np.uint64)
    if not len(values):
        return b""
    size = np.ones(len(values), np.int64)
    for i in range(1, 10):
        size += values >= np.uint64(1 << 7 * i)
    last = np.cumsum(size)
    out = np.empty(int(last[-1]), np.uint8)
    for i in range(int(size.max())):
        some = np.flatnonzero(size > i)
        byte = (values[some] >> np.uint64(7 * i)) & np.uint64(0x7F)
        more = (size[some] > i + 1).astype(np.uint64) << np.uint64(7)
        out[last[some] - size[some] + i] = (byte | more).astype(np.uint8)
    return out.tobytes()


def get_varints(data: bytes) -> np.ndarray:
    """All numbers of a section that holds nothing else."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 0x80)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise BadFile("a number is cut off")
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    if place.max() > 9:
        raise BadFile("a number is too long")
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def _get_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadFile("a number is cut off")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def pack_int64(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.int64)
    return put_varints(zigzag(np.diff(values, prepend=np.int64(0))))


def unpack_int64(blob: bytes) -> np.ndarray:
    return np.cumsum(unzigzag(get_varints(blob)), dtype=np.int64)


def pack_varchar(values: list[bytes], offsets: str = STARTS) -> bytes:
    lengths = np.array([len(v) for v in values], np.int64)
    ends = np.cumsum(lengths)
    stored = {STARTS: ends - lengths, ENDS: ends, LENGTHS: lengths}[offsets]
    section = put_varints(np.diff(stored, prepend=np.int64(0)).view(np.uint64))
    return zstandard.compress(put_varints(np.array([len(section)])) + section + b"".join(values))


def unpack_varchar(blob: bytes, offsets: str = STARTS) -> list[bytes]:
    try:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(blob)
    except zstandard.ZstdError as e:
        raise BadFile("a column can't be decompressed") from e
    size, at = _get_varint(data, 0)
    stored = np.cumsum(get_varints(data[at : at + size]).view(np.int64), dtype=np.int64)
    text = data[at + size :]
    if offsets == STARTS:
        bounds = np.r_[stored, len(text)]
    else:
        bounds = np.r_[0, stored if offsets == ENDS else np.cumsum(stored)]
    if (np.diff(bounds) < 0).any() or bounds[-1] > len(text):
        raise BadFile(f"the offsets aren't {offsets}")
    return [text[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    tag: int
    place: int
    size: int


def dump(columns: list[tuple[str, int, object]], offsets: str = STARTS) -> bytes:
    """A file of (name, tag, values) columns of equal length."""
    if len({len(v) for _, _, v in columns}) > 1:
        raise ValueError("the columns are of unequal length")
    parts, at, meta = [MAGIC], len(MAGIC), []
    for name, tag, values in columns:
        blob = pack_int64(values) if tag == INT64_TAG else pack_varchar(values, offsets)
        parts.append(blob)
        label = name.encode()
        meta += (put_varints(np.array([len(label)])), label, bytes([tag]), struct.pack("<Q", at), put_varints(np.array([len(blob)])))
        at += len(blob)
    n = len(columns[0][2]) if columns else 0
    return b"".join([*parts, put_varints(np.array([n, len(columns)])), *meta, struct.pack("<Q", at), END_MAGIC])


class ColumnFile:
    """An open file: reads its metadata, then only the columns asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < len(MAGIC) + 12 or file.read_at(4, 0) != MAGIC:
            raise BadFile("the magic bytes at the start are missing")
        tail = file.read_at(12, size - 12)
        if tail[8:] != END_MAGIC:
            raise BadFile("the magic bytes at the end are missing")
        (place,) = struct.unpack("<Q", tail[:8])
        if not len(MAGIC) <= place < size - 12:
            raise BadFile("the metadata's place is out of range")
        data = file.read_at(size - 12 - place, place)
        self.rows, at = _get_varint(data, 0)
        n, at = _get_varint(data, at)
        self.columns: list[ColumnMeta] = []
        for _ in range(n):
            size_, at = _get_varint(data, at)
            name, at = data[at : at + size_].decode(), at + size_
            if at + 9 > len(data):
                raise BadFile("the metadata is cut off")
            tag = data[at]
            if tag not in (INT64_TAG, VARCHAR_TAG):
                raise BadFile(f"unknown column type {tag}")
            (blob_at,) = struct.unpack_from("<Q", data, at + 1)
            blob, at = _get_varint(data, at + 9)
            self.columns.append(ColumnMeta(name, tag, blob_at, blob))

    def read(self, names: list[str] | None = None, offsets: str = STARTS) -> dict[str, object]:
        """Values by column in file order: all, or those named."""
        out: dict[str, object] = {}
        for c in self.columns:
            if names and c.name not in names:
                continue
            blob = self.file.read_at(c.size, c.place)
            if len(blob) < c.size:
                raise BadFile("a column is cut off")
            values = unpack_int64(blob) if c.tag == INT64_TAG else unpack_varchar(blob, offsets)
            if len(values) != self.rows:
                raise BadFile(f"column {c.name} has {len(values)} values, not {self.rows}")
            out[c.name] = values
        return out


def open_file(path: str) -> ColumnFile:
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return ColumnFile(fs.open_input_file(root))


def files(path: str) -> list[str]:
    """The files of a path: itself, or those in the folder whose names don't start with a dot or underscore, by name."""
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    fs, root = pafs.FileSystem.from_uri(path) if scheme else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [path]
    found = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.path)]


def read_batches(paths: list[str], size: int, names: list[str] | None = None, offsets: str = STARTS) -> Iterator[dict[str, object]]:
    """Batches of ``size`` rows at most, through the files in the order given; none spans two files."""
    for path in paths:
        file = open_file(path)
        found = file.read(names, offsets)
        for lo in range(0, file.rows, size):
            yield {name: values[lo : lo + size] for name, values in found.items()}


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.paths = files(options["path"])
        self.offsets = options.get("offsets", STARTS)
        self.rows = int(options.get("batchsize", "10000"))

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        file = open_file(part.value)
        found = file.read(self.names, self.offsets)
        columns = []
        for name in self.names:
            values = found[name]
            ints = isinstance(values, np.ndarray)
            columns.append(pa.array(values, pa.int64()) if ints else pa.array(values, pa.binary()).cast(pa.string()))
        whole = pa.RecordBatch.from_arrays(columns, names=self.names)
        for lo in range(0, file.rows, self.rows):
            yield whole.slice(lo, self.rows)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        for f in schema:
            if f.dataType not in (LongType(), StringType()):
                raise ValueError(f"column {f.name}: only bigint and string can be stored")
        self.schema, self.path, self.offsets, self.overwrite = schema, options["path"], options.get("offsets", STARTS), overwrite

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file for a task, under a name that no other attempt has."""
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return _Written("")
        columns = []
        for f, column in zip(self.schema, pa.Table.from_batches(held).columns):
            if column.null_count:
                raise ValueError("nulls can't be stored")
            if f.dataType == LongType():
                columns.append((f.name, INT64_TAG, column.to_numpy()))
            else:
                columns.append((f.name, VARCHAR_TAG, column.cast(pa.large_binary()).to_pylist()))
        data = dump(columns, self.offsets)
        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/.{name}", compression=None) as f:
            f.write(data)
        return _Written(name)

    def commit(self, messages: list) -> None:
        """The new files get their names before the old ones go, so that an end halfway loses nothing."""
        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(SUFFIX)] if self.overwrite else []
        for m in messages:
            if m and m.path:
                fs.move(f"{root}/.{m.path}", f"{root}/{m.path}{SUFFIX}")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        fs, root = self._fs()
        for m in messages:
            if m and m.path:
                fs.delete_file(f"{root}/.{m.path}")


class ColumnFileSource(DataSource):
    """format("columnfile"); options: path, offsets (starts, ends, lengths), columns (names by comma)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        kinds = {INT64_TAG: LongType(), VARCHAR_TAG: StringType()}
        return StructType([StructField(c.name, kinds[c.tag], False) for c in open_file(found[0]).columns if not wanted or c.name in wanted])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and to the one that is active, where Spark looks it up.

    Spark looks in the active session even to tell whether another one knows a format, so each
    is active while it is asked. A thread that has no active session gets ``spark``."""
    sessions = spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession
    found = sessions.getActiveSession()
    active = SparkSession(spark.sparkContext, found.get()) if found.isDefined() else spark
    try:
        for session in (spark, active):
            sessions.setActiveSession(session._jsparkSession)
            try:
                session.dataSource.register(ColumnFileSource)
            except AnalysisException as e:
                if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
                    raise
    finally:
        sessions.setActiveSession(active._jsparkSession)
