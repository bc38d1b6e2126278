"""COPY: a CSV file to one batch of a table, all or nothing."""

from __future__ import annotations

import csv
import io
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .catalog import Batch, Catalog, Table

_BROKEN = "_broken"


class CopyFailed(Exception):
    pass


def mapping(table: Table, columns: tuple[str, ...] | None) -> list[str]:
    """The table's column for each CSV column; a permutation of all of them is needed."""
    names = list(table.columns)
    if columns is None:
        return names
    for c in columns:
        if c not in table.columns:
            raise CopyFailed(f"column {c} from CSV mapping not found in table definition")
    if sorted(columns) != sorted(names):
        raise CopyFailed("the CSV mapping must name every column of the table once")
    return list(columns)


def rows(spark: SparkSession, path: str, header: bool, width: int, multiline: bool = True) -> DataFrame:
    """The file's records as strings c0, c1, ...; empty fields are empty strings.

    A record with another number of fields has its text in ``_broken``.
    """
    schema = StructType([*(StructField(f"c{i}", StringType()) for i in range(width)), StructField(_BROKEN, StringType())])
    read = (
        spark.read.schema(schema)
        .option("header", header).option("enforceSchema", True).option("multiLine", multiline)
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", "\u0000").option("emptyValue", "").option("maxCharsPerColumn", -1)
    )
    return read.csv(path)


def typed(records: DataFrame, table: Table, order: list[str]) -> DataFrame:
    """Records to the table's types; running it fails at the first record that doesn't fit."""
    numbered = records.withColumn("_pos", F.monotonically_increasing_id())
    row = F.concat(F.lit("row "), F.col("_pos").cast("string"))
    broken = F.col(_BROKEN).isNotNull()
    ragged = F.raise_error(F.concat(row, F.lit(" is ragged: "), F.coalesce(F.col(_BROKEN), F.lit(""))))
    columns = {}
    for i, name in enumerate(order):
        value = F.coalesce(F.col(f"c{i}"), F.lit(""))
        if table.columns[name] == "INT64":
            number = value.try_cast("bigint")
            fits = value.rlike(r"^[+-]?[0-9]+\z") & number.isNotNull()
            value = F.when(fits, number).otherwise(
                F.raise_error(F.concat(row, F.lit(f", col {name}: invalid INT64"))).cast("bigint")
            )
        columns[name] = F.when(broken, ragged.cast("bigint" if table.columns[name] == "INT64" else "string")).otherwise(value)
    return numbered.select(*[columns[n].alias(n) for n in table.columns])


def _reason(error: Exception, width: int) -> str:
    """The message of a failed write in the engine's own words."""
    text = str(error)
    m = re.search(r"(row \d+), col .*?: invalid INT64", text)
    if m:
        return m.group()
    m = re.search(r"(row \d+) is ragged: ([^\n]*)", text)
    if m:
        n = len(next(csv.reader(io.StringIO(m[2])), []))
        return f"{m[1]} has {n} columns, expected {width}"
    if "PATH_NOT_FOUND" in text:
        return "failed to open the CSV file: no such file"
    return text.splitlines()[0][:500]


def inside(path: str, root: str | None) -> str:
    """The path, if it lies under the data root; without a root any path will do."""
    if root is None:
        return path
    whole = os.path.realpath(path if os.path.isabs(path) else os.path.join(root, path))
    if os.path.commonpath([whole, os.path.realpath(root)]) != os.path.realpath(root):
        raise CopyFailed(f"{path} is outside the data folder")
    return whole


def run(
    spark: SparkSession, catalog: Catalog, folder: str, name: str, path: str,
    columns: tuple[str, ...] | None = None, header: bool = False, root: str | None = None, multiline: bool = True,
) -> int:
    """Loads a file into a table; returns the number of rows. A failure leaves nothing behind.

    With ``multiline`` a quoted field may hold line ends, and one task reads the
    file; without it the file is split among tasks.
    """
    table = catalog.by_name(name)
    if table is None:
        raise CopyFailed(f"table {name} does not exist")
    order = mapping(table, columns)
    source = inside(path, root)
    target = os.path.join(folder, f"{name}_{catalog.unique_time()}.parquet")
    try:
        data = typed(rows(spark, source, header, len(order), multiline), table, order)
        data.write.option("compression", "zstd").parquet(target)
        n = spark.read.parquet(target).count()  # from the files' footers
    except Exception as e:
        catalog._remove(target)
        raise CopyFailed(_reason(e, len(order))) from e
    if not n:
        catalog._remove(target)
        raise CopyFailed("empty CSV, no data imported")
    if not catalog.append(name, Batch(target, n), table.id):
        catalog._remove(target)
        raise CopyFailed(f"table {name} was removed during import")
    return n
