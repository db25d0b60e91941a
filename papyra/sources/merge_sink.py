"""A sink for stores that take keyed MERGE batches (SNK-14): a Python data source writer with commit messages.

A task hands its rows over in batches of ``batch`` (1000), each staged under a name of its own attempt; nothing shows in the store before
the commit, which merges the batches that the successful attempts named. So a task that is killed and runs again leaves no double row, a failed job
leaves nothing, and a job that runs again merges the same keys anew. A store is a class named by the option ``store`` (dotted), made from the options on
driver and executors, with ``stage(name, rows)``, ``commit(names)`` and ``abort(names)``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from importlib import import_module
from itertools import batched
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


def _store(options: Mapping[str, str]) -> Any:
    module, _, name = options["store"].rpartition(".")
    return getattr(import_module(module), name)(dict(options))


class MergeSink(DataSource):
    """``df.write.format("merge_sink").option("store", ...).mode("append")``."""

    @classmethod
    def name(cls) -> str:
        return "merge_sink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("rows are merged by key: use mode append")
        return _MergeWriter(dict(self.options))


class _MergeWriter(DataSourceWriter):
    def __init__(self, options: Mapping[str, str]):
        self.options, self.batch = options, int(options.get("batch", "1000"))
        if self.batch < 1:
            raise ValueError("a batch holds one row at least")

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, attempt, names = _store(self.options), uuid.uuid4().hex, []
        for i, rows in enumerate(batched(iterator, self.batch)):
            names.append(f"{attempt}-{i:06d}")
            store.stage(names[-1], [r.asDict(recursive=True) for r in rows])
        return Staged(names)

    def commit(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        _store(self.options).commit([n for m in messages if m is not None for n in m.names])

    def abort(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        _store(self.options).abort([n for m in messages if m is not None for n in m.names])


class TableStore:
    """A store in a SQLite file, for one machine: options ``database``, ``table`` and ``key`` (column names with commas between); rows are kept as JSON by key, the last of a key stands.

    Staged batches are rows of a table beside it; the commit is one transaction.
    """

    def __init__(self, options: Mapping[str, str]):
        import sqlite3

        lower = {k.lower(): v for k, v in options.items()}
        self.keys, self.table = lower["key"].split(","), lower["table"]
        if not self.table.isidentifier():
            raise ValueError("the table's name must be an identifier")
        self.con = sqlite3.connect(lower["database"], timeout=60)
        with self.con:
            self.con.execute(f"CREATE TABLE IF NOT EXISTS {self.table} (key TEXT PRIMARY KEY, row TEXT)")
            self.con.execute(f"CREATE TABLE IF NOT EXISTS {self.table}_staged (name TEXT, key TEXT, row TEXT)")

    def stage(self, name: str, rows: list[dict]) -> None:
        with self.con:
            self.con.executemany(f"INSERT INTO {self.table}_staged VALUES (?, ?, ?)", [(name, json.dumps([r[k] for k in self.keys], default=str), json.dumps(r, default=str, sort_keys=True)) for r in rows])

    def commit(self, names: list[str]) -> None:
        with self.con:
            for n in names:
                self.con.execute(f"INSERT OR REPLACE INTO {self.table} SELECT key, row FROM {self.table}_staged WHERE name = ? ORDER BY rowid", (n,))
                self.con.execute(f"DELETE FROM {self.table}_staged WHERE name = ?", (n,))

    def abort(self, names: list[str]) -> None:
        with self.con:
            self.con.executemany(f"DELETE FROM {self.table}_staged WHERE name = ?", [(n,) for n in names])
