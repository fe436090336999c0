"""Keyed tables that grow by what a batch changes: base files in key buckets, deltas of changed rows, and a manifest for each version.

A mutation reads the buckets that its keys fall into, and no others, and writes the changed rows alone (deleted ones as tombstones).  The
manifest of a version names every file that it consists of, so a reader sees one version whole or another, whatever is written
meanwhile.  A manifest is created under the next number only if no other writer has done so; the one that comes second gets a conflict,
so versions of one table form a line that any number of writers share.  Once deltas hold a share of the table, the buckets that they
touch are written anew.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError
from ..operators.tables import first_by, merge_rows, new_rows, sent

#: A manifest that cannot be read is another writer's for so many seconds, and one that was lost after that.
PATIENCE = 60


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    base: dict[str, str] = field(default_factory=dict)  # bucket -> folder
    base_rows: int = 0
    deltas: tuple[dict, ...] = ()  # path, version, rows, buckets


class KeyedTable:
    """A table of ``schema`` (DDL) under ``keys`` in ``folder``; ``buckets`` and ``compact_at`` (share of rows in deltas) are kept by the writers."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 64, compact_at: float = 0.25):
        self.spark, self.folder, self.keys, self.buckets, self.compact_at = spark, folder.rstrip("/"), keys, buckets, compact_at
        self.empty = spark.createDataFrame([], schema)
        self.columns = self.empty.columns
        self._stored = f"{schema}, _version long, _gone boolean, _bucket int"

    # -- files ------------------------------------------------------------------------------------------------------

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self) -> list[int]:
        fs, where = self._files(f"{self.folder}/manifests")
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(where) if s.getPath().getName()[1:].isdigit()) if fs.exists(where) else []

    def _load(self, version: int) -> Manifest | None:
        """None for a manifest that is not whole."""
        fs, where = self._files(f"{self.folder}/manifests/v{version}")
        stream = fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Manifest(**(found := json.loads(text)) | {"deltas": tuple(found["deltas"])})
        except ValueError:
            return None

    def manifest(self, version: int | None = None) -> Manifest:
        """That of a version, or the last whole one."""
        if version is not None:
            return self._load(version) or Manifest()
        return next((m for v in reversed(self._names()) if (m := self._load(v)) is not None), Manifest())

    def version(self) -> int:
        return self.manifest().version

    def _commit(self, seen: Manifest, **changes) -> int:
        """Create the manifest that follows ``seen``; a conflict if another writer was first."""
        names = self._names()
        last = names[-1] if names else 0
        if last != seen.version:
            if self._load(last) is not None:
                raise ConflictError(f"version {last} was written since version {seen.version} was read")
            fs, where = self._files(f"{self.folder}/manifests/v{last}")
            if time.time() - fs.getFileStatus(where).getModificationTime() / 1000 < PATIENCE:
                raise ConflictError(f"version {last} is being written")
        new = Manifest(**(seen.__dict__ | changes | {"version": last + 1}))
        fs, where = self._files(f"{self.folder}/manifests/v{last + 1}")
        try:
            out = fs.create(where, False)  # only if it is not there
        except Exception as e:
            raise ConflictError(f"version {last + 1} is another writer's") from e
        try:
            out.write(json.dumps(new.__dict__).encode())
        finally:
            out.close()
        return new.version

    # -- reads ------------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.empty.withColumns({"_version": F.lit(None).cast("long"), "_gone": F.lit(None).cast("boolean"), "_bucket": F.lit(None).cast("int")})
        return self.spark.read.schema(self._stored).parquet(*paths)

    def _live(self, m: Manifest, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, of some buckets or all: the newest of each key, unless that is a tombstone."""
        base = self._read([p for b, p in m.base.items() if buckets is None or int(b) in buckets])
        deltas = [d for d in m.deltas if buckets is None or buckets & set(d["buckets"])]
        if not deltas:
            return base.select(*self.columns)
        changed = self._read([d["path"] for d in deltas])
        if buckets is not None:
            changed = changed.filter(F.col("_bucket").isin(*buckets))
        newest = first_by(changed, self.keys, [F.desc("_version")]) if len(deltas) > 1 else changed  # a delta has a key once
        old = base.join(sent(newest.select(*self.keys)), self.keys, "left_anti")
        return old.select(*self.columns).unionByName(newest.filter(~F.col("_gone")).select(*self.columns))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last, if none is named), by the files that its manifest names now."""
        return self._live(self.manifest(version))

    def _touched(self, ids: DataFrame) -> set[int]:
        return {r[0] for r in ids.select(self._bucket().alias("b")).distinct().collect()}  # at most as many as buckets

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        return self._live(self.manifest(), self._touched(ids)).join(ids.select(*self.keys).distinct(), self.keys, "left_semi")

    # -- writes -----------------------------------------------------------------------------------------------------

    def _change(self, ids: DataFrame, made: Callable[[DataFrame], DataFrame], gone: bool = False, needs_old: bool = True) -> int:
        """Write the rows that ``made`` makes of the old rows with the keys of ``ids``; returns the version."""
        seen = self.manifest()
        buckets = self._touched(ids)
        old = self.empty
        if needs_old and (seen.base or seen.deltas):
            old = self._live(seen, buckets).join(ids.select(*self.keys).distinct(), self.keys, "left_semi")
        rows = made(old).select(*self.columns).withColumns({"_version": F.lit(seen.version + 1).cast("long"), "_gone": F.lit(gone), "_bucket": self._bucket()})
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        n = self.spark.read.schema(self._stored).parquet(path).count()
        if not n:
            return seen.version
        version = self._commit(seen, deltas=(*seen.deltas, {"path": path, "version": seen.version + 1, "rows": n, "buckets": sorted(buckets)}))
        if sum(d["rows"] for d in seen.deltas) + n > self.compact_at * max(seen.base_rows, 1):
            return self.compact()
        return version

    def replace(self, rows: DataFrame, order: list) -> int:
        """Upsert of whole rows; nothing old is read."""
        return self._change(rows, lambda old: first_by(rows, self.keys, order), needs_old=False)

    def merge(self, rows: DataFrame, order: list, create_only: dict[str, Column] | None = None) -> int:
        """MERGE column by column (see ``tables.merge_rows``)."""
        return self._change(rows, lambda old: merge_rows(old, rows, self.keys, order, create_only))

    def insert(self, rows: DataFrame, order: list) -> int:
        """The rows whose key the table lacks."""
        return self._change(rows, lambda old: new_rows(old, rows, self.keys, order))

    def delete(self, ids: DataFrame) -> int:
        return self._change(ids, lambda old: old, gone=True)

    def compact(self) -> int:
        """Write the buckets that deltas touch anew; the others keep their files."""
        seen = self.manifest()
        buckets = set().union(*(set(d["buckets"]) for d in seen.deltas))
        if not buckets:
            return seen.version
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows = self._live(seen, buckets).withColumns({"_version": F.lit(seen.version).cast("long"), "_gone": F.lit(False), "_bucket": self._bucket()})
        rows.withColumn("bucket", F.col("_bucket")).repartition(min(len(buckets), 1000), "bucket").write.partitionBy("bucket").parquet(path)
        fs, where = self._files(path)
        made = {s.getPath().getName().removeprefix("bucket="): f"{path}/{s.getPath().getName()}" for s in fs.listStatus(where) if s.isDirectory()}
        base = {b: p for b, p in seen.base.items() if int(b) not in buckets} | made
        return self._commit(seen, base=base, base_rows=self._read(list(base.values())).count(), deltas=())

    def expire(self, keep: int = 2) -> None:
        """Delete manifests but the last ``keep``, and the files that only they name."""
        names = self._names()
        kept = [m for v in names[-keep:] if (m := self._load(v)) is not None]
        used = {p.split("/bucket=")[0] for m in kept for p in [*m.base.values(), *(d["path"] for d in m.deltas)]}
        for v in names[:-keep]:
            m = self._load(v) or Manifest()
            for path in {p.split("/bucket=")[0] for p in [*m.base.values(), *(d["path"] for d in m.deltas)]} - used:
                fs, where = self._files(path)
                fs.delete(where, True)
            fs, where = self._files(f"{self.folder}/manifests/v{v}")
            fs.delete(where, False)


def bump(table: KeyedTable, change: Callable[[KeyedTable], int], tries: int = 5) -> int:
    """Apply a change, again from what is there now if another writer was first: the version that it made."""
    for left in reversed(range(tries)):
        try:
            return change(table)
        except ConflictError:
            if not left:
                raise
    raise AssertionError
