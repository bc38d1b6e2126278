"""The catalog: tables with typed columns and an ordered list of immutable batches.

A batch is a folder or file of Parquet. The catalog itself is a JSON file that is
replaced as a whole. Readers take a snapshot of a table's batches; a dropped
table's batches are removed once no snapshot holds them.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from ..plans.problems import Invalid

TYPES = ("INT64", "VARCHAR")


@dataclass
class Batch:
    path: str
    rows: int = -1  # unknown
    owned: bool = True  # whether dropping the table removes it


@dataclass
class Table:
    id: str
    name: str
    columns: dict[str, str]
    batches: list[Batch] = field(default_factory=list)


@dataclass(frozen=True)
class Snapshot:
    """A table's columns and batches at one time."""

    table: str
    columns: dict[str, str]
    batches: tuple[Batch, ...]


def remove_local(path: str) -> None:
    if os.path.isdir(path):
        shutil.rmtree(path, ignore_errors=True)
    elif os.path.exists(path):
        os.remove(path)


class Catalog:
    """Thread-safe registry. Without a folder it lives in memory only."""

    def __init__(self, folder: str | None = None, remove: Callable[[str], None] = remove_local):
        self._lock = threading.RLock()
        self._file = os.path.join(folder, "catalog.json") if folder else None
        self._remove = remove
        self._tables: dict[str, Table] = {}
        self._held: dict[str, int] = {}
        self._doomed: set[str] = set()
        self._last_id = 0
        if self._file and os.path.exists(self._file):
            with open(self._file) as f:
                for t in json.load(f)["tables"]:
                    self._tables[t["name"]] = Table(t["id"], t["name"], t["columns"], [Batch(**b) for b in t["batches"]])

    def _save(self) -> None:
        if not self._file:
            return
        os.makedirs(os.path.dirname(self._file), exist_ok=True)
        data = {"tables": [vars(t) | {"batches": [vars(b) for b in t.batches]} for t in self._tables.values()]}
        new = f"{self._file}.{os.getpid()}.new"
        with open(new, "w") as f:
            json.dump(data, f, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, self._file)

    def unique_time(self) -> int:
        """Nanoseconds, never the same twice."""
        with self._lock:
            self._last_id = max(self._last_id + 1, time.time_ns())
            return self._last_id

    def create(self, name: str, columns: list[tuple[str, str]]) -> str:
        """Adds an empty table; returns its id. Type and duplicate-column problems come together."""
        if not columns:
            raise Invalid(("Table must have at least one column", ""))
        problems, seen = [], set()
        for column, type_ in columns:
            if type_ not in TYPES:
                problems.append((f"Invalid column type: {type_}", ""))
            if column in seen:
                problems.append((f"Duplicate column name: {column}", ""))
            seen.add(column)
        if problems:
            raise Invalid(*problems)
        with self._lock:
            if name in self._tables:
                raise Invalid((f"table {name} already exists", ""))
            table = Table(f"{name}_{self.unique_time()}", name, dict(columns))
            self._tables[name] = table
            self._save()
            return table.id

    def tables(self) -> list[tuple[str, str]]:
        """(id, name) of all tables."""
        with self._lock:
            return [(t.id, t.name) for t in self._tables.values()]

    def by_name(self, name: str) -> Table | None:
        with self._lock:
            return self._tables.get(name)

    def by_id(self, table_id: str) -> Table | None:
        with self._lock:
            return next((t for t in self._tables.values() if t.id == table_id), None)

    def drop(self, table_id: str) -> bool:
        """Removes a table; False if there is none. Its batches go when no reader holds them."""
        with self._lock:
            table = self.by_id(table_id)
            if table is None:
                return False
            del self._tables[table.name]
            self._save()
            self._doomed |= {b.path for b in table.batches if b.owned}
        self._sweep()
        return True

    def append(self, name: str, batch: Batch, table_id: str | None = None) -> bool:
        """Makes a written batch visible; False if the table is gone."""
        with self._lock:
            table = self._tables.get(name)
            if table is None or table_id not in (None, table.id):
                return False
            table.batches.append(batch)
            self._save()
            return True

    @contextmanager
    def snapshot(self, name: str) -> Iterator[Snapshot]:
        """The table as it is now; its batches stay until the end of the block."""
        held = self.acquire(name)
        try:
            yield held
        finally:
            self.release(held)

    def acquire(self, name: str) -> Snapshot:
        with self._lock:
            table = self._tables.get(name)
            if table is None:
                raise Invalid((f"table {name} does not exist", ""))
            held = Snapshot(name, dict(table.columns), tuple(table.batches))
            for b in held.batches:
                self._held[b.path] = self._held.get(b.path, 0) + 1
            return held

    def release(self, held: Snapshot) -> None:
        with self._lock:
            for b in held.batches:
                self._held[b.path] -= 1
                if not self._held[b.path]:
                    del self._held[b.path]
        self._sweep()

    def _sweep(self) -> None:
        with self._lock:
            gone = [p for p in self._doomed if p not in self._held]
            self._doomed -= set(gone)
        for p in gone:
            self._remove(p)
