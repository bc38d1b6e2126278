"""Exact top-k by inner product over a bit-sliced index.

A block of vectors keeps, for each dimension, one bitmap for each binary digit
of the quantised values. For a query the digits' bitmaps are added with carry-
save adders, weighted by the signed binary digits of the query's components:
that gives the bitmaps of all the block's scores. The best rows are then taken
from the most significant digit downwards; rows that are still equal at the
last digit have equal scores, and the smaller ids of them fill the last places.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Scratch, batch

BLOCK_ROWS = 32_768
#: Queries that meet a block of rows at once, and the least for which it is worth sending.
QUERY_ROWS, LEAST_QUERIES = 4096, 128
LARGEST = 1 << 50
_LONG = (1 << 63) - 1


def quantise(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held within plus and minus LARGEST."""
    return np.clip(np.floor(scale * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def _quantised(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.binary())])
    for b in batches:
        ids, vectors = b.column(0).to_pylist(), b.column(1)
        keep, data = [], []
        for i, v in enumerate(ids):
            x = vectors[i].values
            if v is None or x is None or x.null_count:
                continue
            x = x.to_numpy(zero_copy_only=False)
            if np.isfinite(x).all():
                keep.append(v)
                data.append(quantise(x, scale).tobytes())
        if keep:
            yield batch(schema, keep, data)


class Block:
    """The bit-sliced index of some rows, in the order of their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: list[np.ndarray]):
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        width = max((len(v) for v in vectors), default=0)
        x = np.zeros((len(ids), width), np.int64)
        for at, i in enumerate(order):
            x[at, : len(vectors[i])] = vectors[i]
        self.words = (len(ids) + 63) // 64
        self.least = x.min(axis=0) if len(x) else np.zeros(width, np.int64)
        x -= self.least
        self.digits = [int(m).bit_length() for m in (x.max(axis=0) if len(x) else [])]
        self.slices = [
            [self._bitmap(x[:, d] >> s & 1) for s in range(n)] for d, n in enumerate(self.digits)
        ]
        self.all = self._bitmap(np.ones(len(ids), np.int64))

    def _bitmap(self, ones: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.words * 64, np.uint8)
        bits[: len(ones)] = ones
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the scores' binary digits, least first, and what is to be added to each score."""
        columns: list[list[np.ndarray]] = []
        plus = 0
        for d, q in enumerate(query[: len(self.digits)].tolist()):
            plus += q * int(self.least[d])
            place = 0
            while q:  # the signed binary digits of q without two neighbours that aren't zero
                if q & 1:
                    sign = 2 - (q & 3)
                    q -= sign
                    for s, bitmap in enumerate(self.slices[d]):
                        while len(columns) <= place + s:
                            columns.append([])
                        # -b is (1 - b) - 1
                        columns[place + s].append(bitmap if sign > 0 else ~bitmap)
                    if sign < 0:
                        plus -= ((1 << self.digits[d]) - 1) << place
                q >>= 1
                place += 1
        out = []
        at = 0
        while at < len(columns):
            todo = columns[at]
            if len(todo) > 1 and at + 1 == len(columns):
                columns.append([])
            while len(todo) > 2:
                a, b, c = todo.pop(), todo.pop(), todo.pop()
                x = a ^ b
                carry = x & c
                x ^= c
                a = a & b
                a |= carry
                todo.append(x)
                columns[at + 1].append(a)
            if len(todo) == 2:
                a, b = todo
                columns[at + 1].append(a & b)
                todo = [a ^ b]
            out.append(todo[0] if todo else np.zeros(self.words, np.uint64))
            at += 1
        return out, plus

    def top(self, query: np.ndarray, own_row: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but the query's own."""
        digits, plus = self.scores(query)
        equal = self.all.copy()
        own = np.flatnonzero(self.rows == own_row)
        if len(own):
            equal[own[0] >> 6] &= ~np.uint64(1 << int(own[0] & 63))
        sure, n_sure = np.zeros(self.words, np.uint64), 0
        for digit in reversed(digits):
            high = equal & digit
            n = n_sure + int(np.bitwise_count(high).sum())
            if n <= k:
                sure |= high
                n_sure = n
                equal &= ~digit
                if n == k:
                    equal[:] = 0
                    break
            else:
                equal = high
        picked = np.r_[self._places(sure), self._places(equal)[: k - n_sure]]
        if not len(picked):
            return []
        total = [plus] * len(picked)
        for s, digit in enumerate(digits):
            ones = (digit[picked >> 6] >> (picked & 63).astype(np.uint64)) & np.uint64(1)
            total = [t + (int(o) << s) for t, o in zip(total, ones)]
        return list(zip(self.ids[picked].tolist(), total))

    def _places(self, bitmap: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[some].view(np.uint8), bitorder="little").reshape(-1, 64)
        at, bit = np.nonzero(bits)
        return some[at] * 64 + bit


_PACKED = pa.schema([("part", pa.int64()), ("blob", pa.binary())])


def _packed(batches: Iterator[pa.RecordBatch], index: bool) -> Iterator[pa.RecordBatch]:
    """All rows of a partition, pickled together: as an index or as they are."""
    ids, rows, vectors = [], [], []
    for b in batches:
        ids += b.column("vec_id").to_pylist()
        rows += b.column("row").to_pylist()
        vectors += [np.frombuffer(x, np.int64) for x in b.column("x").to_pylist()]
    kind = Block if index else lambda *x: x
    made = kind(np.array(ids, np.int64), np.array(rows, np.int64), vectors)
    yield batch(_PACKED, [TaskContext.get().partitionId()], [pickle.dumps(made, 5)])


def _search(key, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    schema = pa.schema([("qrow", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    out = []
    if left.num_rows and right.num_rows:
        index: Block = pickle.loads(left.column("blob")[0].as_py())
        for i, row, x in zip(*pickle.loads(right.column("blob")[0].as_py())):
            for v, score in index.top(x, int(row), k):
                out.append((int(row), int(i), v, max(-_LONG - 1, min(_LONG, score))))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """The k rows of greatest inner product for each row whose vec_id is divisible by ``every``.

    Vectors (vec_id, embedding) become integers floor(scale * x). A row isn't
    its own answer. Returns query_id, rank (from 1), vec_id and score; equal
    scores come by vec_id. Rows whose id or vector is null, or whose vector
    holds a null or a number that isn't finite, take no part. Of vectors of
    unequal length the shorter counts as filled up with zeros. Rows with
    repeated ids are rows of their own. Components beyond 2 to the 50th and
    scores beyond the range of long are held at those bounds.

    Blocks of queries meet blocks of rows, so that no task holds more than one
    of each; each pair gives k rows for a query at most. The index is sent once
    for each ``QUERY_ROWS`` queries; more often only while that gives fewer pairs
    of blocks than twice as many as can run at once.
    """
    scratch = Scratch(spark, "bitsliced")
    rows = vectors.select("vec_id", "embedding").mapInArrow(lambda x: _quantised(x, scale), "vec_id long, x binary")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, m = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    blocks = max(1, -(-n // BLOCK_ROWS))
    busy = -(-2 * spark.sparkContext.defaultParallelism // blocks)
    parts = max(1, -(-m // QUERY_ROWS), min(busy, -(-m // LEAST_QUERIES)))
    index = rows.repartition(blocks).mapInArrow(lambda x: _packed(x, True), "part long, blob binary")
    index = scratch.save(index, "index")
    query = rows.where(asked).repartition(parts).mapInArrow(lambda x: _packed(x, False), "part long, blob binary")
    query = scratch.save(query, "queries")
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.select(F.col("part").alias("block"), number(parts).alias("part"), "blob")
    right = query.select(number(blocks).alias("block"), "part", "blob")
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        lambda key, a, b: _search(key, a, b, k), "qrow long, query_id long, vec_id long, score long"
    )
    place = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id"))
    out = found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return scratch.finish(out)
