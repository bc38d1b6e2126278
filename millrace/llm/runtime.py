"""What the operators share: the shared folder, scratch tables, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/checkpoints/millrace"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from spark.checkpoint.dir. Only a local master, where driver
    and executors are one process, may do without the setting.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        found = LOCAL_DEFAULT
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_MADE: ContextVar[list[Scratch] | None] = ContextVar("made", default=None)


@contextmanager
def scratches(keep_results: bool = False) -> Iterator[None]:
    """Removes at the end what operators leave in the block. Some return a
    DataFrame that still reads their tables; whoever has written it elsewhere
    doesn't need these any more. With ``keep_results`` they go only if the block fails."""
    made: list[Scratch] = []
    token = _MADE.set(made)
    done = False
    try:
        yield
        done = True
    finally:
        _MADE.reset(token)
        if not (done and keep_results):
            for s in made:
                s.drop()


class Scratch:
    """A folder of tables under the shared folder, for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        made = _MADE.get()
        if made is not None:
            made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and returns the written table, which has no lineage."""
        where = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def inner(self, name: str) -> Scratch:
        """A folder in this one, which goes with it."""
        out = copy(self)
        out.path = f"{self.path}/{name}"
        return out

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Checkpoints a narrow result and removes the scratch tables."""
        out = df.checkpoint(eager=True)
        self.drop()
        return out


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def sorted_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Cuts a stream that is sorted by ``key`` into pieces of whole runs of it.

    All columns are fixed-width numbers without nulls. A run never spans two
    pieces, so memory is bounded by a batch and the longest run.
    """
    carry: list[dict[str, np.ndarray]] = []
    for b in batches:
        now = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        k = now[key]
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1], side="left")) if k[0] != k[-1] else 0
        if carry and carry[0][key][-1] != k[0]:
            yield _joined(carry)
            carry = []
        if cut:
            yield _joined([*carry, {n: v[:cut] for n, v in now.items()}])
            carry = []
        carry.append({n: v[cut:] for n, v in now.items()})
    if carry:
        yield _joined(carry)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
