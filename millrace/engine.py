"""The engine: a catalog, a Spark session of its own, and queries as jobs."""

from __future__ import annotations

import os
import threading
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import request, select
from .plans.problems import Invalid
from .sources import csv_copy
from .sources.catalog import Batch, Catalog

CREATED, PLANNING, RUNNING, COMPLETED, FAILED = "CREATED", "PLANNING", "RUNNING", "COMPLETED", "FAILED"


def own_session(spark: SparkSession) -> SparkSession:
    """A session with integers that wrap around and names that tell cases apart; the caller's stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.enabled", "false")
    own.conf.set("spark.sql.caseSensitive", "true")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def _message(error: BaseException) -> str:
    text = str(error)
    for known in ("division by zero", "comparison not implemented for this type"):
        if known in text:
            return known
    return text.splitlines()[0][:500] if text else type(error).__name__


@dataclass(frozen=True)
class Stored:
    """A result that was written: its folder, and the columns that its rows are in the order of."""

    path: str
    order: tuple[str, ...]


@dataclass
class Job:
    id: str
    definition: object
    state: str = CREATED
    result: pa.Table | Stored | None = None
    error: list[tuple[str, str]] | None = None
    future: Future | None = None

    @property
    def is_copy(self) -> bool:
        return self.id.startswith("COPY_")


class Engine:
    """Tables and queries over one Spark session. All methods may be called from any thread.

    With a folder, results of jobs are written there and read as far as they are asked
    for; without one they are kept in memory.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, data_root: str | None = None, workers: int = 8):
        self.spark = own_session(spark)
        self.folder = folder
        self.data_root = data_root
        if folder:
            os.makedirs(os.path.join(folder, "tables"), exist_ok=True)
        self.catalog = Catalog(folder)
        if folder:
            self.catalog._remove(os.path.join(folder, "results"))  # of jobs that nobody knows any more
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(workers, thread_name_prefix="query")

    def close(self) -> None:
        self._pool.shutdown()

    # Tables

    def attach(self, name: str, path: str) -> str:
        """Registers existing Parquet as a table; integers and strings are its columns, others are left out."""
        columns = []
        for f in self.spark.read.parquet(path).schema:
            kind = f.dataType.simpleString()
            if kind in ("tinyint", "smallint", "int", "bigint"):
                columns.append((f.name, "INT64"))
            elif kind == "string":
                columns.append((f.name, "VARCHAR"))
        table_id = self.catalog.create(name, columns)
        self.catalog.append(name, Batch(path, owned=False))
        return table_id

    # Queries without a job

    def select(self, definition: dict | request.Select) -> DataFrame:
        """The DataFrame of a SELECT, with columns c0, c1, ...

        The snapshot is released at once, as a DataFrame's end is unknown:
        dropping the table takes its files from DataFrames that are still in use.
        """
        query = definition if isinstance(definition, request.Select) else request.select(definition)
        plan = select.plan(query, self.catalog)
        try:
            return select.frame(self.spark, plan)
        finally:
            if plan.snapshot:
                self.catalog.release(plan.snapshot)

    def scan(self, name: str, limit: int = 0) -> DataFrame:
        """All columns of a table under their names; the first ``limit`` rows if it is positive."""
        with self.catalog.snapshot(name) as held:
            columns = tuple(request.ColumnRef(c, name) for c in held.columns)
            return self.select(request.Select(columns, limit=limit if limit > 0 else None)).toDF(*held.columns)

    def copy(self, query: request.Copy) -> int:
        if not self.folder:
            raise csv_copy.CopyFailed("the engine has no folder for tables")
        tables = os.path.join(self.folder, "tables")
        return csv_copy.run(self.spark, self.catalog, tables, query.table, query.path, query.columns, query.header, self.data_root)

    # Jobs

    def submit(self, query: request.Select | request.Copy, definition: object = None) -> str:
        """Starts a query; returns its id. An invalid one raises Invalid and leaves no job."""
        if isinstance(query, request.Copy):
            if self.catalog.by_name(query.table) is None:
                raise Invalid((f"table {query.table} does not exist", ""))
            return self._start("COPY", definition, lambda: self.copy(query) and None)
        plan = select.plan(query, self.catalog)
        return self._start("SELECT", definition, lambda: self._run(plan))

    def _run(self, plan: select.Plan) -> pa.Table | Stored:
        try:
            if not self.folder:
                table = select.frame(self.spark, plan, hidden=True).toArrow()
                if plan.snapshot:
                    if not plan.order_by:
                        table = table.sort_by([(n, "ascending") for n in select.HIDDEN])
                    table = table.drop_columns(list(select.HIDDEN))
                return table
            path = os.path.join(self.folder, "results", f"{self.catalog.unique_time()}.parquet")
            if plan.snapshot and plan.limit and plan.where is not None and not plan.order_by:
                self._first_matches(plan, path)
            else:
                select.frame(self.spark, plan, hidden=True).write.parquet(path)
            return Stored(path, select.HIDDEN if plan.snapshot and not plan.order_by else ())
        finally:
            if plan.snapshot:
                self.catalog.release(plan.snapshot)

    def _first_matches(self, plan: select.Plan, path: str) -> None:
        """Goes through the files, four times as many in each step, until enough rows are found."""
        todo, step, left = select.files(self.spark, plan.snapshot.batches), 1, plan.limit
        while True:
            pieces = list(islice(todo, step))
            select.frame(self.spark, replace(plan, limit=left), True, pieces).write.mode("append").parquet(path)
            left = plan.limit - self.spark.read.parquet(path).count()
            if not pieces or left <= 0:
                return
            step *= 4

    def _read(self, stored: Stored, limit: int) -> pa.Table:
        df = self.spark.read.parquet(stored.path)
        names = [c for c in df.columns if c not in select.HIDDEN]
        order = stored.order or ("_metadata.file_path", "_metadata.row_index")
        df = df.orderBy(*map(F.col, order)).select(*names)
        return (df.limit(limit) if limit > 0 else df).toArrow()

    def _start(self, kind: str, definition: object, work) -> str:
        job = Job(f"{kind}_{self.catalog.unique_time()}", definition)

        def run() -> None:
            job.state = RUNNING
            try:
                job.result = work()
                job.state = COMPLETED
            except BaseException as e:
                job.error = e.problems if isinstance(e, Invalid) else [(_message(e), "")]
                job.state = FAILED

        with self._lock:
            self._jobs[job.id] = job
        job.future = self._pool.submit(run)
        return job.id

    def jobs(self) -> list[Job]:
        with self._lock:
            return list(self._jobs.values())

    def job(self, job_id: str) -> Job | None:
        with self._lock:
            return self._jobs.get(job_id)

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        job = self.job(job_id)
        job.future.result(timeout)
        return job

    def result(self, job_id: str, limit: int = 0, flush: bool = False) -> dict:
        """A completed SELECT's result by columns, ``limit`` rows at most if it is positive.

        No rows: no columns either. Flushing forgets the job.
        """
        job = self.job(job_id)
        table = self._read(job.result, limit) if isinstance(job.result, Stored) else job.result
        if flush:
            with self._lock:
                self._jobs.pop(job_id, None)
            if isinstance(job.result, Stored):
                self.catalog._remove(job.result.path)
        if limit > 0:
            table = table.slice(0, limit)
        return {"rowCount": table.num_rows, "columns": [c.to_pylist() for c in table.columns] if table.num_rows else []}
