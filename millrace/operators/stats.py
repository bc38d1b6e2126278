"""Column statistics: means of integers, byte counts of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType


def ascii_bytes(c: Column) -> Column:
    """Bytes below 128. In UTF-8 these are the ASCII characters."""
    return F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")).cast("bigint")


def column_stats(df: DataFrame) -> DataFrame:
    """One row: ``rows``, and for each integer column c ``c_mean``, for each string
    column ``c_ascii_bytes`` and ``c_bytes``. An empty table has zeros.

    All in one pass, combined in each task before the shuffle.
    """
    out = [F.count("*").alias("rows")]
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ByteType | ShortType | IntegerType | LongType):
            out.append(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{f.name}_mean"))
        elif isinstance(f.dataType, StringType):
            out.append(F.coalesce(F.sum(ascii_bytes(c)), F.lit(0).cast("bigint")).alias(f"{f.name}_ascii_bytes"))
            out.append(F.coalesce(F.sum(F.octet_length(c).cast("bigint")), F.lit(0).cast("bigint")).alias(f"{f.name}_bytes"))
    return df.agg(*out)
