"""Joins in time: the last row before, and the rows within an interval.

Time is cut into bins, so a key that holds most rows is dealt by its bins; what crosses a bin's edge is carried (one row for each key and
bin) or copied (to the next bins), never looked for by comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def last_before(left: DataFrame, right: DataFrame, by: list[str], at: str, value: list[str], tie: list[str] | None = None, seconds: int = 86_400) -> DataFrame:
    """``left`` with the ``value`` columns of the last row of ``right`` at or before it (null where there is none), within ``by``.

    Both have ``by`` and ``at``; ``tie`` orders rows of ``right`` at one time, of which the last counts.  Rows with a null key or time find
    none, and rows of ``right`` that have one are not found.
    """
    held = F.struct(F.col(at).alias("_at"), *[F.col(c) for c in tie or []], F.struct(*[F.col(v).alias(v) for v in value]).alias("_v"))
    known = right.select(*by, at, *(tie or []), *value).dropna(subset=[*by, at])
    theirs = known.select(*by, F.col(at).alias("_t"), _bin(F.col(at), seconds).alias("_bin"), held.alias("_held"), F.lit(0).alias("_side"), F.lit(None).cast(left_type(left)).alias("_row"))
    row = F.struct(*[F.col(c) for c in left.columns])
    ours = left.select(*by, F.col(at).alias("_t"), _bin(F.col(at), seconds).alias("_bin"), F.lit(None).cast(theirs.schema["_held"].dataType).alias("_held"), F.lit(1).alias("_side"), row.alias("_row"))
    # the last of each bin, carried over the bins before a row's own
    ends = theirs.groupBy(*by, "_bin").agg(F.max("_held").alias("_end")).select(*by, "_bin", "_end", F.lit(False).alias("_asked"))
    asked = ours.filter(F.col("_t").isNotNull()).select(*by, "_bin").distinct().select(*by, "_bin", F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"), F.lit(True).alias("_asked"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    marks = ends.unionByName(asked).groupBy(*by, "_bin").agg(F.max("_end").alias("_end"), F.max("_asked").alias("_asked"))
    carried = marks.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).filter("_asked").select(*by, "_bin", "_carried")
    within = Window.partitionBy(*by, "_bin").orderBy("_t", "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    merged = ours.unionByName(theirs).withColumn("_own", F.last("_held", ignorenulls=True).over(within)).filter("_side = 1")
    found = merged.join(carried, [*by, "_bin"], "left").withColumn("_found", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carried")))
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in left.columns], *[F.col(f"_found._v.{v}").alias(v) for v in value])


def left_type(df: DataFrame):
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("r")).schema["r"].dataType


def within(left: DataFrame, right: DataFrame, by: list[str], at: str, other: str, seconds: int) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows with equal ``by`` and ``other`` from ``at`` to ``at`` plus ``seconds``, both ends included.

    ``other`` is the right side's time; its remaining columns must not clash with the left's.
    """
    ours = left.withColumn("_bin", F.explode(F.array(_bin(F.col(at), seconds), _bin(F.col(at), seconds) + 1)))
    theirs = right.withColumn("_bin", _bin(F.col(other), seconds))
    gap = F.unix_micros(F.col(other).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return ours.join(theirs, [*by, "_bin"]).filter((gap >= 0) & (gap <= seconds * 1_000_000)).drop("_bin")
