"""Two streams joined in time: what follows within an interval, state that the watermark lets go, and late rows counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lifecycle import PROVIDER


def follows(left: DataFrame, right: DataFrame, by: str, at: str, other: str, seconds: int, late: str) -> DataFrame:
    """Rows of ``right`` that follow one of ``left`` with the same ``by`` within ``seconds``, both ends included.

    As streams, rows wait in state until the watermark (``late`` behind the newest row of the slower side) rules a partner out; rows that
    come later than that are dropped.  As tables it is the plain join.
    """
    a = left.withWatermark(at, late) if left.isStreaming else left
    b = right.withColumnRenamed(by, f"_{by}")
    b = b.withWatermark(other, late) if right.isStreaming else b
    span = (F.col(other) >= F.col(at)) & (F.col(other) <= F.col(at) + F.make_dt_interval(secs=F.lit(seconds)))
    return a.join(b, (F.col(by) == F.col(f"_{by}")) & span).drop(f"_{by}")


def run_table(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> int:
    """Write all that a stream has to a table; the number of rows that it dropped for being late."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
