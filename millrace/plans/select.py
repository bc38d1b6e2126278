"""SELECT: validation, and the DataFrame it becomes.

Rows come in the order of their batches, files and places in the files, which
Spark's file metadata tells without a stored column. ORDER BY breaks its ties
by that order. No order is forced on a result that asks for none: whoever
collects it sorts by the hidden columns, which a limit keeps in its top-n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import SPARK_TYPE, Binder, Typed
from ..sources.catalog import Batch, Catalog, Snapshot
from . import request
from .problems import Collector, Invalid

BATCH, FILE, ROW = "_batch", "_file", "_row"
HIDDEN = (BATCH, FILE, ROW)


def discover(query: request.Select) -> tuple[str, bool]:
    """The first table name of the SELECT list, then of WHERE, depth first; and whether there is any column."""
    any_column = False
    stack = [e for e in (query.where, *reversed(query.columns)) if e is not None]
    while stack:
        e = stack.pop()
        match e:
            case request.ColumnRef():
                any_column = True
                if e.table:
                    return e.table, True
            case request.Binary():
                stack += [e.right, e.left]
            case request.Unary():
                stack.append(e.operand)
            case request.Call():
                stack += reversed(e.arguments)
    return "", any_column


@dataclass(frozen=True)
class Plan:
    """A valid SELECT over a snapshot, or over nothing."""

    columns: tuple[Typed, ...]
    where: Typed | None
    order_by: tuple[request.OrderBy, ...]
    limit: int | None
    snapshot: Snapshot | None


def _where(binder: Binder, e: request.Expr) -> Typed:
    bound = binder.bind(e)
    if bound.type != "BOOLEAN":
        raise Invalid(("where expression must return boolean", "WhereClause"))
    return bound


def validate(query: request.Select, snapshot: Snapshot | None) -> Plan:
    binder = Binder(snapshot.table if snapshot else "", snapshot.columns if snapshot else {})
    found = Collector()
    columns = [found.of(binder.bind, e) for e in query.columns]
    where = found.of(_where, binder, query.where) if query.where is not None else None
    for i, o in enumerate(query.order_by):
        if not 0 <= o.index < len(columns):
            found.add(f"invalid column index: {o.index}", f"OrderByClause {i}")
    if query.limit is not None and query.limit < 0:
        found.add("limit must be non-negative")
    found.check()
    return Plan(tuple(columns), where, query.order_by, query.limit, snapshot)


def plan(query: request.Select, catalog: Catalog) -> Plan:
    """Validates a SELECT. The plan holds its snapshot until it is released; an invalid one holds none."""
    if not query.columns:
        raise Invalid(("No columns specified for SELECT", ""))
    name, any_column = discover(query)
    if not name:
        if any_column:
            raise Invalid(("no table name specified and query contains column references", ""))
        return validate(query, None)
    snapshot = catalog.acquire(name)
    try:
        return validate(query, snapshot)
    except BaseException:
        catalog.release(snapshot)
        raise


@dataclass(frozen=True)
class Piece:
    """Files of a table's batch, and how many rows are wanted of each; all if it is None."""

    batch: int
    paths: tuple[str, ...]
    rows: int | None = None


def whole(batches: tuple[Batch, ...]) -> list[Piece]:
    return [Piece(i, (b.path,)) for i, b in enumerate(batches)]


def files(spark: SparkSession, batches: tuple[Batch, ...]) -> Iterator[Piece]:
    """Every file in the order of its rows."""
    for i, b in enumerate(batches):
        for path in sorted(spark.read.parquet(b.path).inputFiles()):
            yield Piece(i, (path,))


def _row_count(spark: SparkSession, path: str) -> int:
    """A Parquet file's number of rows, from its footer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
    try:
        return reader.getRecordCount()
    finally:
        reader.close()


def first_rows(spark: SparkSession, batches: tuple[Batch, ...], limit: int) -> list[Piece]:
    """Exactly the first ``limit`` rows; the footers of the files that hold them are all that is looked at."""
    out: list[Piece] = []
    for piece in files(spark, batches) if limit else ():
        n = _row_count(spark, *piece.paths)
        if n > limit:
            return [*out, Piece(piece.batch, piece.paths, limit)]
        if out and out[-1].batch == piece.batch:
            out[-1] = Piece(piece.batch, out[-1].paths + piece.paths)
        else:
            out.append(piece)
        limit -= n
        if not limit:
            break
    return out


def scan(spark: SparkSession, columns: dict[str, str], pieces: list[Piece]) -> DataFrame:
    """The pieces' rows with the hidden order columns; names are case-sensitive."""
    if not pieces:
        schema = ", ".join(f"`{c.replace('`', '``')}` {SPARK_TYPE[t]}" for c, t in columns.items())
        hidden = f"{BATCH} int, {FILE} string, {ROW} bigint"
        return spark.createDataFrame([], f"{schema}, {hidden}")
    parts = []
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    for p in pieces:
        own = spark.read.parquet(*p.paths)
        own = own.select(
            *[quoted(c).cast(SPARK_TYPE[t]).alias(c) for c, t in columns.items()],
            F.lit(p.batch).alias(BATCH), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW),
        )
        parts.append(own if p.rows is None else own.where(F.col(ROW) < p.rows))
    while len(parts) > 1:  # in pairs, so that the plan's depth is the logarithm of the batches
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def frame(spark: SparkSession, p: Plan, hidden: bool = False, pieces: list[Piece] | None = None) -> DataFrame:
    """The plan's DataFrame: columns c0, c1, ... and, if asked for, the hidden order.

    It is over ``pieces`` of the snapshot, if they are given. A limit without WHERE
    and ORDER BY opens just the files that hold its rows, and needs no sort.
    ``spark`` must have ANSI mode off, so that integers wrap around.
    """
    with_table = p.snapshot is not None
    limit = p.limit
    if with_table:
        if pieces is None and limit is not None and p.where is None and not p.order_by:
            pieces, limit = first_rows(spark, p.snapshot.batches, limit), None
        df = scan(spark, p.snapshot.columns, whole(p.snapshot.batches) if pieces is None else pieces)
    else:
        df = spark.range(1).select()
    if p.where is not None:
        df = df.where(p.where.build())
    names = [f"c{i}" for i in range(len(p.columns))]
    order = [F.col(n) for n in HIDDEN] if with_table else []
    df = df.select(*[c.build().alias(n) for c, n in zip(p.columns, names)], *order)
    keys: list[Column] = [F.col(names[o.index]).asc() if o.ascending else F.col(names[o.index]).desc() for o in p.order_by]
    if limit is not None or keys:
        keys += order
        df = df.orderBy(*keys) if keys else df
    if limit is not None:
        df = df.limit(limit)
    return df if hidden and with_table else df.select(*names)
