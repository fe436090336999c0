"""Mutations of keyed tables as plans: each takes tables and gives the tables that replace them.

No table format with MERGE is assumed.  A caller writes the result as the next snapshot and switches to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import checked


def sent(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` for a broadcast if it has at most so many rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in that order.  ``order`` should be total."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def new_rows(table: DataFrame, rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows that an insert-if-absent adds: keys not in the table, the first of each key in the batch."""
    return first_by(rows.join(table.select(*keys), keys, "left_anti"), keys, order)


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``table`` with the rows whose key it lacks."""
    return table.unionByName(new_rows(table, rows, keys, order).select(*table.columns))


def replace_rows(table: DataFrame, rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Upsert of whole rows: a batch row replaces the table's of its key."""
    newest = first_by(rows, keys, order)
    return table.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(*table.columns))


def merge_rows(table: DataFrame, rows: DataFrame, keys: list[str], order: list, create_only: dict[str, Column] | None = None) -> DataFrame:
    """MERGE: the batch's values win column by column, nulls keep the old value.

    ``create_only`` columns are set when a key is new and never again.  The join is full outer on the keys, one
    shuffle of each side.
    """
    create_only = create_only or {}
    newest = first_by(rows, keys, order)
    kept = [c for c in table.columns if c not in keys and c not in create_only]
    old = table.withColumn("_old", F.lit(True)).alias("o")
    new = newest.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in kept if c in newest.columns])
    both = old.join(new, keys, "full_outer")
    value = {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in newest.columns else F.col(c) for c in kept}
    value |= {c: F.when(F.col("_old"), F.col(c)).otherwise(made) for c, made in create_only.items()}
    return both.select(*[F.col(c) if c in keys else value[c].alias(c) for c in table.columns])


def require_keys(rows: DataFrame, columns: list[str], what: str) -> DataFrame:
    """Reject the whole batch if one row lacks its provenance."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    return checked(rows, present, f"{what} need {' and '.join(columns)}")


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of some keys, each once; unknown keys give nothing."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def unnest_join(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Join each element of a list; an element that occurs twice joins twice."""
    return df.withColumn(key, F.explode(column)).join(other, key)


def hydrate(paths: DataFrame, path_key: list[str], ids: str, rows: DataFrame, key: str, value: list[str], out: str) -> DataFrame:
    """Replace a list of ids by the rows they name: order kept, ids without a row skipped, no path lost."""
    named = paths.select(*path_key, F.posexplode(ids).alias("_at", key)).join(rows.select(key, *value), key)
    lists = named.groupBy(*path_key).agg(F.array_sort(F.collect_list(F.struct("_at", key, *value))).alias("_rows"))
    found = F.transform("_rows", lambda r: F.struct(r[key].alias(key), *[r[v].alias(v) for v in value]))
    kind = f"array<struct<{key}: {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{v}: {rows.schema[v].dataType.simpleString()}" for v in value) + ">>"
    return paths.join(lists.select(*path_key, found.alias(out)), path_key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(kind)))


def payload_filter(df: DataFrame, conditions: dict) -> DataFrame:
    """All keys must hold; a list of values means any of them, and an array column matches by any element."""
    for key, wanted in conditions.items():
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        if df.schema[key].dataType.typeName() == "array":
            df = df.filter(F.arrays_overlap(F.col(key), F.array(*[F.lit(v) for v in values])))
        else:
            df = df.filter(F.col(key).isin(*values))
    return df


def read_through(requests: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(answers for every request, new cache rows): hits are joined, only distinct misses go to ``compute``."""
    misses = compute(requests.join(cache.select(key), key, "left_anti").dropDuplicates([key]))
    misses = misses.select(*cache.columns)
    return requests.join(cache.unionByName(misses), key, "left"), misses
