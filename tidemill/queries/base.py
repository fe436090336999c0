"""Registration of queries, and the driver's tables seen as the engine's.

``documents`` are chunks, ``embeddings`` their vectors, ``events`` logs; suppliers, parts, orders and customers are a
graph: a line item is a relation of its supplier to its part, and an order is a chunk that mentions its customer
and the parts of its lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def text_id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def relates(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    # numbers are grouped, which are shorter than the ids made of them
    rows = lines.groupBy("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("quantity"))
    return rows.select(
        text_id("S", "l_suppkey").alias("src_id"),
        text_id("P", "l_partkey").alias("dst_id"),
        F.concat(F.lit("SUPPLIES_"), "l_returnflag").alias("type"),
        (F.col("quantity") / 50).alias("confidence"),
        text_id("o", "l_orderkey").alias("chunk_id"),
        F.concat(F.lit("d"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("doc_id"),
        F.lit(None).cast("string").alias("evidence_span"),
    )


RELATES = """relates AS (
  SELECT 'S' || l_suppkey AS src_id, 'P' || l_partkey AS dst_id, 'SUPPLIES_' || l_returnflag AS type, l_quantity / 50 AS confidence,
         'o' || l_orderkey AS chunk_id, 'd' || l_orderkey || '-' || l_linenumber AS doc_id
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag, l_orderkey, l_linenumber ORDER BY l_quantity) = 1
)"""
UNDIRECTED = """und AS (
  SELECT src_id AS a, dst_id AS b, type, confidence, chunk_id, doc_id FROM relates
  UNION ALL SELECT dst_id, src_id, type, confidence, chunk_id, doc_id FROM relates WHERE src_id <> dst_id
)"""


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = tables(spark, folder, "lineitem", "orders")
    parts = lines.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"), F.min("l_linenumber").alias("at"))
    parts = parts.select(text_id("o", "l_orderkey").alias("chunk_id"), text_id("P", "l_partkey").alias("entity_id"), (F.col("q") / 50).alias("confidence"), F.col("at").alias("char_start"))
    buyers = orders.select(text_id("o", "o_orderkey").alias("chunk_id"), text_id("C", "o_custkey").alias("entity_id"), (F.pmod(F.col("o_orderkey"), F.lit(97)) / 97).alias("confidence"), F.lit(0).alias("char_start"))
    return parts.unionByName(buyers).withColumn("char_end", F.col("char_start") + 1).withColumn("surface", F.col("entity_id"))


MENTIONS = """mentions AS (
  SELECT 'o' || l_orderkey AS chunk_id, 'P' || l_partkey AS entity_id, max(l_quantity) / 50 AS confidence, min(l_linenumber) AS char_start FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'o' || o_orderkey, 'C' || o_custkey, (o_orderkey % 97) / 97, 0 FROM orders
)"""

#: The hashed form of a text in SQL; enough for the characters of the driver's tables.
NORMAL = "trim(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def uuid_sql(text: str) -> str:
    h = f"sha256({text})"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )
