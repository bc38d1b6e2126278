"""CRC-64 by the polynomial of ECMA-182: start 0, most significant bit first, no final change.

Such a checksum is linear, so blocks are summed apart and then joined: the sum
of A followed by B is that of A moved on by B's length, plus that of B. Files
are read in blocks by as many tasks as they have blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the polynomial without its highest term.
POLYNOMIAL = 0x42F0E1EBA9EA3693
BLOCK = 8 << 20
_MASK = (1 << 64) - 1
_LANES = 2048


@cache
def _table() -> np.ndarray:
    """The sum of each single byte: eight steps of division."""
    c = np.arange(256, dtype=np.uint64) << np.uint64(56)
    for _ in range(8):
        c = np.where(c >> np.uint64(63) != 0, (c << np.uint64(1)) ^ np.uint64(POLYNOMIAL), c << np.uint64(1))
    return c


def _times(a: int, b: int) -> int:
    """Product of two polynomials, reduced."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) & _MASK ^ (POLYNOMIAL if a >> 63 else 0)
        b >>= 1
    return out


@lru_cache(65_536)
def _power(n_bytes: int) -> int:
    """x to the 8 n-th power, reduced: multiplying by it moves a sum on by n bytes."""
    out, base = 1, 1 << 8
    while n_bytes:
        if n_bytes & 1:
            out = _times(out, base)
        base = _times(base, base)
        n_bytes >>= 1
    return out


def join(left: int, right: int, right_bytes: int) -> int:
    """The sum of two pieces that follow each other."""
    return _times(left, _power(right_bytes)) ^ right


def _columns(rows: np.ndarray) -> np.ndarray:
    """Sums of equally long rows of bytes, all at once."""
    table = _table()
    crc = np.zeros(len(rows), np.uint64)
    for column in np.ascontiguousarray(rows.T):
        crc = table[(crc >> np.uint64(56)) ^ column] ^ (crc << np.uint64(8))
    return crc


@lru_cache(1024)
def _movers(n_bytes: int) -> np.ndarray:
    """For each byte of a sum, what it becomes when the sum is moved on by n bytes."""
    out = np.zeros((8, 256), np.uint64)
    image = _power(n_bytes)
    for bit in range(64):
        out[bit // 8, (np.arange(256) >> bit % 8) & 1 == 1] ^= np.uint64(image)
        image = (image << 1) & _MASK ^ (POLYNOMIAL if image >> 63 else 0)
    return out


def _joined(crcs: np.ndarray, n_bytes: int) -> int:
    """The sum of equally long pieces that follow each other, joined two by two."""
    whole = 1 << (len(crcs) - 1).bit_length()
    crcs = np.r_[np.zeros(whole - len(crcs), np.uint64), crcs]  # zeros in front change nothing
    while len(crcs) > 1:
        move, left = _movers(n_bytes), crcs[::2]
        crcs = crcs[1::2].copy()
        for k in range(8):
            crcs ^= move[k][(left >> np.uint64(8 * k)) & np.uint64(255)]
        n_bytes *= 2
    return int(crcs[0])


def crc64(data: bytes, crc: int = 0) -> int:
    """The sum of bytes that follow others whose sum is ``crc``."""
    raw = np.frombuffer(data, np.uint8)
    width = max(1, len(raw) // _LANES)
    whole = len(raw) // width * width if len(raw) >= 64 else 0
    if whole:
        crc = join(crc, _joined(_columns(raw[:whole].reshape(-1, width)), width), whole)
    table = _table()
    for byte in data[whole:]:
        crc = int(table[crc >> 56 ^ byte]) ^ (crc << 8) & _MASK
    return crc


def crc64_many(values: list[bytes]) -> list[int]:
    """Sums of several byte strings: short ones side by side, byte by byte."""
    table = _table()
    out = [crc64(v) if len(v) > 4096 else 0 for v in values]
    short = sorted((i for i, v in enumerate(values) if 0 < len(v) <= 4096), key=lambda i: -len(values[i]))
    for lo in range(0, len(short), 1024):
        part = short[lo : lo + 1024]
        size = np.array([len(values[i]) for i in part])
        rows = np.zeros((int(size[0]), len(part)), np.uint8)
        for k, i in enumerate(part):
            rows[: size[k], k] = np.frombuffer(values[i], np.uint8)
        crc = np.zeros(len(part), np.uint64)
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # longest first, so a prefix goes on
        for column, n in zip(rows, live.tolist()):
            now = crc[:n]
            crc[:n] = table[(now >> np.uint64(56)) ^ column[:n]] ^ (now << np.uint64(8))
        for i, c in zip(part, crc.tolist()):
            out[i] = c
    return out


def crc64_hex(column: str):
    """A column of 16 hexadecimal digits for strings or binaries; nulls stay null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        data = [b"" if x is None else x.encode() if isinstance(x, str) else bytes(x) for x in s]
        return pd.Series([None if x is None else f"{c:016x}" for x, c in zip(s, crc64_many(data))])

    return run(F.col(column))


def block_order(size: int, block: int = BLOCK, alternating: bool = False, clamp: bool = True) -> list[tuple[int, int]]:
    """(place, length) of the blocks of a file in reading order.

    Alternating takes even blocks from the start and odd ones from the end.
    A block beyond the start is held at it (``clamp``), or left out.
    """
    out = []
    for i in range(-(-size // block)):
        place = i * block if not alternating or i % 2 == 0 else size - (i + 1) * block
        if place < 0:
            if not clamp:
                continue
            place = 0
        if place < size:
            out.append((place, min(block, size - place)))
    return out


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, length) of a file, or of a folder's files. Spark's own listing leaves empty files out."""
    fs, root = _store(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(root))
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.type == pafs.FileType.File]


_SUMS = pa.schema([("path", pa.string()), ("i", pa.int32()), ("n", pa.int64()), ("crc", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            fs, root = _store(r["path"])
            with fs.open_input_file(root) as f:
                data = f.read_at(r["n"], r["place"])
            row = {"path": r["path"], "i": r["i"], "n": len(data), "crc": crc64(data).to_bytes(8, "big")}
            yield pa.RecordBatch.from_pylist([row], schema=_SUMS)


def _fold(t: pa.Table) -> pa.Table:
    crc = 0
    for r in t.sort_by("i").to_pylist():
        crc = join(crc, int.from_bytes(r["crc"], "big"), r["n"])
    return pa.Table.from_pylist([{"path": t.column("path")[0].as_py(), "crc64": f"{crc:016x}"}])


def file_checksums(spark: SparkSession, path: str, block: int = BLOCK, alternating: bool = False, clamp: bool = True) -> DataFrame:
    """(path, crc64) of each file of a path, in 16 hexadecimal digits.

    Blocks are read and summed apart; of a file only a row for each block meets.
    An empty file has sum 0. ``alternating`` and ``clamp`` are those of block_order.
    """
    listed = spark.createDataFrame(_listed(path), "path string, length bigint")
    n = F.greatest(F.ceil(F.col("length") / block), F.lit(1)).cast("int")
    each = listed.select("path", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    from_start = F.col("i").cast("bigint") * block
    place = from_start
    if alternating:
        place = F.when(F.col("i") % 2 == 1, F.col("length") - (F.col("i").cast("bigint") + 1) * block).otherwise(from_start)
        if clamp:
            place = F.greatest(place, F.lit(0).cast("bigint"))
    size = F.when(place < 0, 0).otherwise(F.least(F.lit(block).cast("bigint"), F.col("length") - place))
    each = each.select("path", "i", F.greatest(place, F.lit(0).cast("bigint")).alias("place"), size.alias("n"))
    sums = each.repartition(F.xxhash64("path", "i")).mapInArrow(_read, "path string, i int, n bigint, crc binary")
    return sums.groupBy("path").applyInArrow(_fold, "path string, crc64 string")
