"""Tables on files whose changes rewrite only the files that hold a changed key.

A table is a folder of data files and a manifest per version, which lists the
files of that version. A change looks up which files hold its keys (only the key
column is read, with the file that each row lies in), rewrites these files and
lists them anew; all others stay as they are in the next version. Since the table
is laid out by ranges of its key, keys that lie together touch few files.

The manifest of a version appears as one folder, so a reader sees a change whole
or not at all, and a second writer of the same version fails. Files of earlier
versions stay, for readers that began on them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfledger.operators import maintenance
from shelfledger.operators.ordered import ordered_window, up_to_here
from shelfledger.session import stage

_MANIFEST = "file string"
#: Rows of a file at most, about: a task sorts the rows of one file, in memory.
FILE_ROWS = 1_000_000


class Change(NamedTuple):
    """What a change did: the version it made, and the files that it took out and put in."""

    version: int
    removed: list[str]
    added: list[str]


class KeyedTable:
    """A table of ``schema`` with unique ``key`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def create(self, rows: DataFrame, files: int) -> Change:
        """Version 0, in about ``files`` files by ranges of the key, more where they would be large."""
        return self._commit(0, [], self._write(rows, max(files, math.ceil(rows.count() / FILE_ROWS))))

    def version(self) -> int:
        return self._manifests().agg(F.max("version")).first()[0]

    def files(self, version: int | None = None) -> list[str]:
        at = self.version() if version is None else version
        return sorted(r.file for r in self._manifests().where((F.col("version") == at) & F.col("file").isNotNull()).collect())

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.files(version))

    def find(self, keys: DataFrame) -> DataFrame:
        """The ``keys`` that the table holds, each with its file."""
        files = self.files()
        if not files:
            return self.spark.createDataFrame([], self.schema).select(self.key, F.lit("").alias("file"))
        held = self._rows(files).select(self.key, F.col("_metadata.file_path").alias("file"))
        return held.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], inserts: DataFrame | None = None) -> Change:
        """The next version: ``change`` applied to the rows of the files that hold ``keys``, and ``inserts``.

        ``change`` gets whole files, so it must leave rows of other keys alone.
        """
        version = self.version()
        listed = self.files(version)
        hit = sorted(r.file for r in self.find(keys).select("file").distinct().collect())
        added = self._write(change(self._rows(hit)), len(hit)) if hit else []
        if inserts is not None and not inserts.isEmpty():
            # As large as the others, so that many small inserts do not make one file each.
            share = max(1, round(len(listed) * inserts.count() / max(1, self.read(version).count())))
            added += self._write(inserts, share)
        return self._commit(version + 1, sorted(set(listed) - set(hit)), added, hit)

    def merge(self, changes: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Change:
        """The next version: ``change`` applied to the rows of the files hit, with the columns of ``changes`` beside them.

        ``changes`` has one row per key; its columns are NULL on rows of other keys, and
        keys that the table does not hold are ignored. Rows and changes go to the ranges
        of the new files together, so that the table is shuffled once and not joined first.
        """
        version = self.version()
        listed = self.files(version)
        hit = sorted(r.file for r in self.find(changes).select("file").distinct().collect())
        if not hit:
            return self._commit(version + 1, listed, [])
        rows = self._rows(hit).withColumn("_row", F.lit(True))
        beside = F.struct(*[c for c in changes.columns if c != self.key]).alias("_change")
        both = rows.unionByName(changes.where(F.col(self.key).isNotNull()).select(self.key, beside, F.lit(False).alias("_row")), allowMissingColumns=True)
        placed = both.repartitionByRange(len(hit), self.key).sortWithinPartitions(self.key, "_row")
        # A change lies in front of its row.
        met = F.first("_change", ignorenulls=True).over(up_to_here(ordered_window(self.key, ["_row"])))
        merged = change(placed.withColumn("_change", met).where("_row").select(*self.schema.names, "_change.*"))
        return self._commit(version + 1, sorted(set(listed) - set(hit)), self._store(merged), hit)

    def upsert(self, changes: DataFrame, order: Sequence[str] = ("seq",)) -> Change:
        """Insert or replace by key; the last write wins."""
        last = stage(maintenance.latest(changes, self.key, order).select(*self.schema.names), "upserts")
        found = stage(self.find(last), "upsert-keys")
        known = last.join(found.select(self.key), self.key, "left_semi").select(*self.schema.names)

        def change(rows: DataFrame) -> DataFrame:
            return rows.join(known.select(self.key), self.key, "left_anti").select(*self.schema.names).unionByName(known)

        return self.rewrite(found, change, last.join(found.select(self.key), self.key, "left_anti"))

    def overwrite(self, changes: DataFrame, columns: Sequence[str], order: Sequence[str] = ("seq",)) -> Change:
        """Replace ``columns`` of the rows whose key has a change; other keys are ignored."""
        last = stage(maintenance.last_values(changes, columns, self.key, order), "overwrites")
        return self.merge(last, lambda rows: maintenance.overwritten(rows, self.schema.names, columns))

    def delete(self, removed: DataFrame) -> Change:
        return self.rewrite(removed, lambda rows: maintenance.delete(rows, removed, self.key))

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def _write(self, rows: DataFrame, files: int) -> list[str]:
        return self._store(rows.select(*self.schema.names).repartitionByRange(max(1, files), self.key).sortWithinPartitions(self.key))

    def _store(self, placed: DataFrame) -> list[str]:
        where = f"{self.path}/data/{uuid.uuid4().hex}"
        placed.select(*self.schema.names).write.parquet(where)
        made = self.spark.read.schema(self.schema).parquet(where).select("_metadata.file_path").distinct()
        return sorted(r.file_path for r in made.collect())

    def _manifests(self) -> DataFrame:
        form = StructType().add("file", "string").add("version", "integer")
        return self.spark.read.schema(form).option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest")

    def _commit(self, version: int, kept: list[str], added: list[str], removed: Sequence[str] = ()) -> Change:
        # The row without a file says that the version is there, be it empty.
        rows = self.spark.createDataFrame([(f,) for f in [None, *kept, *added]], _MANIFEST)
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")
        return Change(version, list(removed), added)
