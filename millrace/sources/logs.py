"""A generated log table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the generated table.
HOSTS = ("192.168.1.1", "10.0.0.1", "localhost", "db-server", "app-node-01")
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")
ROWS = 100_000


def logs(spark: SparkSession, rows: int = ROWS, seed: int = 42, start: int | None = None) -> DataFrame:
    """timestamp (start + row), value in [0, 10000), host and log_level.

    Values are hashes of row and seed, so that they don't depend on partitions.
    """
    start = int(time.time()) if start is None else start
    draw = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n).cast("bigint"))
    pick = lambda names, salt: F.element_at(F.array(*map(F.lit, names)), (draw(len(names), salt) + 1).cast("int"))
    return spark.range(rows).select(
        (F.col("id") + F.lit(start)).alias("timestamp"), draw(10_000, 1).alias("value"),
        pick(HOSTS, 2).alias("host"), pick(LEVELS, 3).alias("log_level"),
    )
