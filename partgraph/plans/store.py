"""The 13 tables as Parquet folders below one root.

A load writes new folders and then names them in a new, numbered pointer file. Readers follow the
newest pointer, so they see all of a load or nothing of it, and a lost driver leaves the old tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from partgraph.model import CELLS, TABLES, dependants


#: Bytes from which a folder is left alone by merges, and bytes of a merged file.
MERGED_BYTES = 128 << 20


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- pointer -----------------------------------------------------------------------

    def _pointers(self) -> list[int]:
        folder = self._path(f"{self.root}/_pointer")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _pointer(self, number: int) -> str:
        return f"{self.root}/_pointer/{number:012d}.json"

    def _tables_at(self, number: int) -> dict[str, list[str]] | None:
        """What a pointer names; None if it is still being written, or left so by a lost driver."""
        file = self._fs.open(self._path(self._pointer(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        except ValueError:
            return None
        finally:
            file.close()

    def _named(self, number: int) -> list[str]:
        return [f for folders in (self._tables_at(number) or {}).values() for f in folders]

    def current(self) -> dict[str, list[str]]:
        """Folders that make up each table now: the newest pointer that is whole."""
        found = (self._tables_at(number) for number in reversed(self._pointers()))
        return next((tables for tables in found if tables is not None), {})

    def version(self) -> int:
        """Number of the current pointer; 0 before the first."""
        return max(self._pointers(), default=0)

    def publish(self, folders: Mapping[str, list[str]], expected: int | None = None) -> None:
        """Make ``folders`` the current tables.

        Fails if another load published meanwhile: since ``expected``, the version the caller read, or
        while this one is being named. The pointer is created under its own name and only if there is none, which
        file systems and object stores do in one step; a rename is a copy on the latter.
        """
        numbers = self._pointers()
        if expected is not None and max(numbers, default=0) != expected:
            raise RuntimeError("another load published first; repeat this one")
        target = self._path(self._pointer((numbers[-1] if numbers else 0) + 1))
        try:
            out = self._fs.create(target, False)
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            raise RuntimeError("another load published first; repeat this one") from None
        try:
            out.write(bytearray(json.dumps(dict(folders), sort_keys=True).encode()))
        finally:
            out.close()

    def publish_or_discard(self, folders: Mapping[str, list[str]], expected: int, written: Iterable[str]) -> None:
        """Publish, or delete the folders ``written`` for it if another load came first."""
        try:
            self.publish(folders, expected)
        except RuntimeError:
            self.discard(written)
            raise

    # -- tables ------------------------------------------------------------------------

    def read(self, table: str) -> DataFrame:
        """The table with its declared types; a table never loaded is empty."""
        return self.read_folders(table, self.current().get(table, []))

    def read_all(self, names: Iterable[str] = TABLES) -> dict[str, DataFrame]:
        current = self.current()
        return {t: self.read_folders(t, current.get(t, [])) for t in names}

    def read_folders(self, table: str, folders: list[str]) -> DataFrame:
        schema = TABLES[table].schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def write(
        self, df: DataFrame, table: str, metrics: Mapping[str, Column], split_by: str | None = None
    ) -> tuple[str, dict[str, Any]]:
        """Write a new folder, not yet visible. Returns it with the metrics, taken during the write."""
        folder = f"{self.root}/{table}/load-{uuid.uuid4().hex}"
        observed = Observation()
        measured = df.observe(observed, *[m.alias(name) for name, m in metrics.items()])
        if split_by is not None:
            measured.drop(CELLS).write.partitionBy(split_by).parquet(folder)
        else:
            measured.select(*TABLES[table].columns).write.parquet(folder)
        return folder, observed.get

    def append(self, df: DataFrame, table: str) -> int:
        """Append rows as they are and return their number; nothing is written for an empty frame."""
        version, current = self.version(), self.current()
        folder, seen = self.write(to_declared(df, table), table, {"rows": F.count(F.lit(1))})
        if seen["rows"]:
            self.publish_or_discard({**current, table: [*current.get(table, []), folder]}, version, [folder])
        else:
            self.discard([folder])
        return seen["rows"]

    def truncate(self, table: str, cascade: bool = True) -> list[str]:
        """Empty a table and, with ``cascade``, all tables that reference it.

        Returns the emptied tables; a table the store does not have is left out, without error.
        """
        version, current = self.version(), self.current()
        emptied = [t for t in [table, *(dependants(table) if cascade else [])] if t in current]
        if emptied:
            self.publish({t: [] if t in emptied else folders for t, folders in current.items()}, version)
        return emptied

    # -- retention ---------------------------------------------------------------------

    def merge_small(self, at_least: int = 8, small: int = MERGED_BYTES) -> dict[str, int]:
        """Rewrite the small folders of each table that has ``at_least`` of them as one; returns how many went into it.

        Appends leave a folder each. Folders of ``small`` bytes or more stay as they are, so a row is rewritten only while its
        folder is small. All tables are published at once and hold the same rows as before; the old folders stay for readers
        until ``remove_old``.
        """
        version, current = self.version(), self.current()
        merged, written, counts = dict(current), [], {}
        try:
            for table, folders in current.items():
                sizes = {f: self._fs.getContentSummary(self._path(f)).getLength() for f in folders}
                few = [f for f in folders if sizes[f] < small]
                if len(few) < max(at_least, 2):
                    continue
                files = max(1, sum(sizes[f] for f in few) // MERGED_BYTES)
                rows = self.read_folders(table, few).coalesce(files)  # small on purpose: at most ``small`` bytes a folder
                folder, seen = self.write(rows, table, {"rows": F.count(F.lit(1))})
                written.append(folder)
                if self.read_folders(table, [folder]).count() != seen["rows"]:
                    raise RuntimeError(f"{table}: {seen['rows']} rows merged, others found")
                merged[table] = [*[f for f in folders if f not in few], folder]
                counts[table] = len(few)
            if counts:
                self.publish(merged, version)
        except Exception:
            self.discard(written)
            raise
        return counts

    def remove_old(self, keep: int = 2) -> int:
        """Delete pointers before the last ``keep`` and the folders that only those name; returns the number of folders.

        Readers of the versions kept go on undisturbed. Folders go before their pointers, so that a lost driver leaves
        nothing that the next call does not find. Folders that no pointer ever named may be another load's and stay.
        """
        numbers = self._pointers()
        whole = [n for n in numbers if self._tables_at(n) is not None]
        first = whole[-max(keep, 1) :][0] if whole else 0  # one left unfinished is no version
        gone = [n for n in numbers if n < first]
        named = {f for n in numbers if n >= first for f in self._named(n)}
        old = {f for n in gone for f in self._named(n)} - named
        removed = [f for f in sorted(old) if self._fs.exists(self._path(f))]
        for folder in removed:  # as named: rows that a quarantine set aside beside it stay
            self._fs.delete(self._path(folder), True)
        for number in gone:
            self._fs.delete(self._path(self._pointer(number)), False)
        return len(removed)

    def discard(self, folders: Iterable[str]) -> None:
        """Delete folders of a load that no pointer ever named."""
        for folder in folders:
            self._fs.delete(self._path(folder.removesuffix("/_OK=true")), True)


def to_declared(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in their declared types; columns the frame lacks are null."""
    columns = []
    for f in TABLES[table].schema.fields:
        source = F.col(f.name) if f.name in df.columns else F.lit(None)
        columns.append(source.try_cast(f.dataType).alias(f.name))
    return df.select(*columns, *[c for c in df.columns if c.startswith("_")])
