"""Chunks shared by documents: the registry of sources is the truth, everything else is projected from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SOURCE
from . import tables

FIELDS = ("doc_id", "uri", "page", "char_start", "char_end", "ingested_at")


def first_occurrences(chunks: DataFrame) -> DataFrame:
    """Of chunks that repeat within a document, the first."""
    return tables.first_by(chunks, ["doc_id", "chunk_id"], ["ord"])


def renumbered(chunks: DataFrame) -> DataFrame:
    """ord counts a document's distinct chunks from 0 in their first order."""
    return first_occurrences(chunks).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1)


def occurrences(chunks: DataFrame) -> DataFrame:
    """Every chunk with ``nth``, which counts the places of a chunk within its document from 1; ord is that of ``renumbered`` where nth is 1."""
    placed = chunks.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("ord")))
    return placed.withColumn("ord", F.count_if(F.col("nth") == 1).over(Window.partitionBy("doc_id").orderBy("ord")).cast("int") - 1)


def register_sources(registry: DataFrame, rows: DataFrame) -> DataFrame:
    return tables.insert_if_absent(registry, rows, ["chunk_id", "doc_id"], ["char_start", "char_end"])


def source_lists(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """Every requested chunk with its sources by document, and an empty list where there are none."""
    lists = registry.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("sources"))
    full = ids.select("chunk_id").distinct().join(lists, "chunk_id", "left")
    return full.withColumn("sources", F.coalesce("sources", F.array().cast(f"array<{SOURCE}>")))


def doc_ids(sources: str = "sources"):
    """A chunk's distinct documents, in the order of its sources."""
    return F.array_distinct(F.transform(sources, lambda s: s["doc_id"]))


def project(chunks: DataFrame, registry: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk rows with rebuilt sources and doc_ids, orphaned ids): overwrites, so it converges however often it runs."""
    lists = source_lists(ids, registry)
    kept = lists.filter(F.size("sources") > 0).withColumn("doc_ids", doc_ids())
    return chunks.drop("sources", "doc_ids").join(kept, "chunk_id"), orphans(ids, registry)


def orphans(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """Ids without a source, with whatever columns (such as their place) they came with."""
    return ids.join(registry.select("chunk_id"), "chunk_id", "left_anti")


def chunks_of(ids: DataFrame, chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks by id with their sources; a chunk that no document holds drops out."""
    lists = registry.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    lists = lists.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("sources"))
    return chunks.join(lists, "chunk_id")


def remove_document(registry: DataFrame, doc_id) -> tuple[DataFrame, DataFrame]:
    """(the registry without a document, the chunk ids it held)."""
    own = F.col("doc_id") == doc_id
    return registry.filter(~F.coalesce(own, F.lit(False))), registry.filter(own).select("chunk_id").distinct()


def only_owned(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks that only one given document holds, as (doc_id, chunk_id)."""
    mine = registry.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "chunk_id").distinct()
    other = registry.select(F.col("chunk_id").alias("_c"), F.col("doc_id").alias("_d"))
    return mine.join(other, (F.col("chunk_id") == F.col("_c")) & (F.col("doc_id") != F.col("_d")), "left_anti")
