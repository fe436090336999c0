"""A cache with lifetimes as a table.  It is never needed for right results: what cannot be read is a miss."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import Snapshots
from . import tables

#: What a store that fails raises.
ERRORS = (PySparkException, Py4JError)
CACHE = "key string, value string, expires_at timestamp"


def get(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """(key, value) of every asked key; null where there is no entry or its time is over."""
    alive = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("key", "value")
    return keys.select("key").distinct().join(alive, "key", "left")


def put(cache: DataFrame, rows: DataFrame, ttl_s: int | None, now: Column) -> DataFrame:
    """Set (key, value) for ``ttl_s`` seconds, or for good; entries whose time is over go."""
    until = F.lit(None).cast("timestamp") if ttl_s is None else F.timestamp_seconds(F.unix_micros(now.cast("timestamp")) / 1e6 + ttl_s)
    alive = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return tables.replace_rows(alive, rows.select("key", "value", until.alias("expires_at")), ["key"], ["value"])


def delete_prefix(cache: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(cache without the keys of a prefix, those keys)."""
    hit = F.startswith(F.col("key"), F.lit(prefix))
    return cache.filter(~hit), cache.filter(hit).select("key")


class StoredCache:
    """The cache in a folder of versions.  An error of the store makes a miss or no write, and is counted."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "cache"):
        self.spark, self.store, self.name, self.errors = spark, Snapshots(spark, folder), name, 0

    def _table(self) -> DataFrame:
        return self.store.read(self.name, CACHE)

    def get(self, keys: list[str], now: Column) -> dict[str, str]:
        asked = self.spark.createDataFrame([(k,) for k in keys], "key string")
        try:
            return {r["key"]: r["value"] for r in get(self._table(), asked, now).collect() if r["value"] is not None}
        except ERRORS:
            self.errors += 1
            return {}

    def put(self, values: dict[str, str], ttl_s: int | None, now: Column) -> None:
        try:
            rows = self.spark.createDataFrame(list(values.items()), "key string, value string")
            self.store.write(self.name, put(self._table(), rows, ttl_s, now))
        except ERRORS:
            self.errors += 1

    def delete_prefix(self, prefix: str) -> int:
        try:
            kept, gone = delete_prefix(self._table(), prefix)
            n = gone.count()
            if n:
                self.store.write(self.name, kept)
            return n
        except ERRORS:
            self.errors += 1
            return 0
