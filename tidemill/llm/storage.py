"""The operators' tables: inputs, and what jobs hand on in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import share_package
from ..shared import discard, exists, materialize, new_path, shared_dir

__all__ = ["discard", "exists", "materialize", "new_path", "read_table", "shared_dir", "small_batches"]


#: Bytes of an Arrow batch on its way to a Python worker, so that a worker holds little at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's Python operators; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
