"""Row numbers and running totals over whole tables or large groups, without one task that holds them all.

Rows are dealt out by range and sorted inside their partition; a row's number is its place there plus what the partitions
before it hold.  Only one sum for each partition and group meets in a window, so a group may hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

#: monotonically_increasing_id() holds the partition above these bits, and the place inside it below.
PLACE_BITS = 33


def _part() -> Column:
    return F.shiftright("_at", PLACE_BITS)


def _dealt(df: DataFrame, order: list[Column | str], within: list[str]) -> DataFrame:
    """The rows by range and in order, as a table, with the partition and place of each under ``_at``."""
    dealt = df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    return materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "dealt")


def _with_earlier(dealt: DataFrame, within: list[str], total: Column) -> DataFrame:
    """Each row with ``_first``, where its group begins in its partition, and ``_before``, the group's ``total`` in partitions before."""
    keys = [f"_k{n}" for n in range(len(within))]
    named = [F.col(c).alias(k) for c, k in zip(within, keys, strict=True)]
    held = dealt.groupBy(_part().alias("_part"), *named).agg(total.alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(within, keys, strict=True)], _part() == F.col("_part"))
    return dealt.join(held, same).drop("_part", *keys)


def positions(df: DataFrame, order: list[Column | str], within: list[str] | None = None, name: str = "position") -> DataFrame:
    """``df`` with the 0-based place (long) of each row by ``order``, counted within each value of ``within`` (null is a value).

    Rows that tie are numbered in any order, once and for all: the result reads a table of the shared folder.  An empty table gives
    no rows.  Columns whose names begin with an underscore are the caller's to avoid.
    """
    found = _with_earlier(_dealt(df, order, within or []), within or [], F.count("*"))
    return found.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before")


def running_totals(df: DataFrame, value: str, order: list[Column | str], within: list[str] | None = None, name: str = "total") -> DataFrame:
    """``df`` with the sum of the long column ``value`` up to and with each row by ``order``, within each value of ``within``.

    As ``positions``; rows that tie come one after the other.  A null counts nothing.
    """
    within = within or []
    dealt = _dealt(df, order, within)
    local = Window.partitionBy(_part(), *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = _with_earlier(dealt.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0))), within, F.sum(value))
    return found.withColumn(name, F.col("_local") + F.col("_before")).drop("_at", "_first", "_before", "_local")
