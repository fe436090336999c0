"""Counts, quantiles and distinct counts that are kept as columns and merged: a period's sketches answer for any union of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the sketches' errors: of a quantile's rank (k = 200), and of a count of distinct values as a share (12 bits).
RANK_ERROR, COUNT_ERROR = 0.0333, 0.05


def daily(rows: DataFrame, at: str, group: str, value: str, who: str) -> DataFrame:
    """(day, group, n, total, values, who): one row for each day and group, which holds sketches of its values and of who was seen.

    Null values and nobody are in neither sketch; ``n`` counts the values.
    """
    kept = rows.select(F.to_date(at).alias("day"), group, F.col(value).cast("double").alias("_value"), F.col(who).alias("_who"))
    return kept.groupBy("day", group).agg(F.count("_value").alias("n"), F.sum("_value").alias("total"), F.kll_sketch_agg_double("_value").alias("values"), F.hll_sketch_agg("_who").alias("who"))


def merged(periods: DataFrame, group: list[str]) -> DataFrame:
    """The rows of ``daily`` summed by ``group``; what is merged can be merged again."""
    return periods.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("who").alias("who"))


def quantiles(sketched: DataFrame, wanted: list[float]) -> DataFrame:
    """One row for each quantile of each row: the other columns, q, and estimate."""
    rest = [c for c in sketched.columns if c not in ("values", "who")]
    found = F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("values", F.lit(q)).alias("estimate")) for q in wanted])
    return sketched.select(*rest, F.explode(found).alias("_found")).select(*rest, "_found.*")


def distinct_of(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)
