"""A corpus pipeline over ``documents``: filters, near-duplicates, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) that calls one operator on all that its predecessor kept; its
result is written as Parquet and read again as the next one's ``docs``.  Rows with a null text go through like
empty ones.  Every stage decides by row, whether its id is null, repeated or shared by several texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.decontaminate import decontaminate
from tidemill.llm.neardup import near_duplicates
from tidemill.llm.quality import score_quality
from tidemill.llm.registry import packed
from tidemill.llm.storage import discard, materialize, read_table
from tidemill.llm.toxicity import score_toxicity

#: Rows held by a broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS = 2_000_000


def same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    """``df`` with the columns of ``docs`` alone, whatever characters their names hold."""
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows under a number of their own each, as a table, so that it stays the same; and its column's name."""
    name, taken = "row", {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def without(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The rows whose number is not among ``dropped``, which is counted before it may be broadcast."""
    dropped = materialize(dropped.select(row), "dropped-rows")
    return rows.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, row, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return same_columns(score_toxicity(docs, docs, read_table(spark, sf_dir, "labels")).filter("predicted = 0"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of low quality go."""
    return same_columns(score_quality(docs, docs, read_table(spark, sf_dir, "labels")).filter("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest id stays (the first of several, a null id last).

    Rows with no words are in no group; of those that repeat an id and a text one stays.
    """
    rows, row = numbered(docs)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias(row), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    own = rows.select(row, F.col("doc_id").alias("id"), F.md5("text").alias("digest")).join(found, row)
    alone = F.col("component").isNull()
    own = own.select(row, "id", "component", F.when(alone, F.col("id")).alias("own_id"), F.when(alone, F.col("digest")).alias("own_text"))
    group = ["component", "own_id", "own_text"]
    own = materialize(own, "rows-of-groups")
    first = own.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", row)).alias("first"))
    return same_columns(without(rows, row, own.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_anti")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, row = numbered(docs)
    found = decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return same_columns(without(rows, row, found.filter("contaminated").select(F.col("doc_id").alias(row))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, each with its place in a sequence."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Trained scores, sketches and tokens have no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; a stage's table goes once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
