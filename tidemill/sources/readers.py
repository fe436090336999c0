"""Tables: the data lake's own and every format that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_package, small_batches


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """parquet, csv, json, orc, text, binaryFile, jdbc: a named schema avoids a pass for inference."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def record(ledger: DataFrame, doc_id: str) -> DataFrame:
    """A ledger row by key; empty for an unknown id."""
    return ledger.filter(F.col("doc_id") == doc_id)


class Snapshots:
    """Versioned tables in a folder: a write makes the next version, a read takes the last complete one.

    The marker that Spark writes last makes a version complete, so readers never see half of one and a job that is
    run again after a loss simply makes another.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self, name: str) -> list[int]:
        fs, where = self._files(f"{self.folder}/{name}")
        if not fs.exists(where):
            return []
        found = []
        for status in fs.listStatus(where):
            last = status.getPath().getName()
            done_fs, done = self._files(f"{self.folder}/{name}/{last}/_SUCCESS")
            if last.startswith("v") and last[1:].isdigit() and done_fs.exists(done):
                found.append(int(last[1:]))
        return sorted(found)

    def read(self, name: str, schema: str) -> DataFrame:
        """The current version, or an empty table of that shape."""
        have = self.versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{have[-1]}") if have else self.spark.createDataFrame([], schema)

    def stored(self, name: str) -> DataFrame:
        """The current version with the columns that its files have."""
        return self.spark.read.parquet(f"{self.folder}/{name}/v{self.versions(name)[-1]}")

    def write(self, name: str, df: DataFrame) -> int:
        version = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{version}")
        return version

    def add(self, name: str, df: DataFrame, version: int) -> None:
        """The rows that a version adds to a growing table; a version that is written again replaces its own rows."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{version}")

    def read_until(self, name: str, schema: str, version: int) -> DataFrame:
        """A growing table's rows of all complete versions up to one."""
        have = [f"{self.folder}/{name}/v{v}" for v in self.versions(name) if v <= version]
        return self.spark.read.schema(schema).parquet(*have) if have else self.spark.createDataFrame([], schema)

    def expire(self, name: str, keep: int) -> None:
        """Delete all but the last ``keep`` complete versions of a table that is written whole."""
        for v in self.versions(name)[:-keep]:
            files, where = self._files(f"{self.folder}/{name}/v{v}")
            files.delete(where, True)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a log table, which has no versions."""
        df.write.mode("append").parquet(f"{self.folder}/{name}")
