"""Bounded samples of labelled documents, and fits on them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo."""
    return F.crc32(doc_id.cast("string")) % modulus


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for the rows that no fit may see (false for a null id, which no label joins)."""
    return F.coalesce(bucket(doc_id, modulus) == remainder, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame | None, label: str, allowed: Column, rows: int, max_bytes: int) -> DataFrame:
    """At most ``rows`` labelled texts of at most ``max_bytes`` in all: (text, label), in a fixed random order.

    ``allowed`` is a condition on doc_id.  With ``labels`` the label is that table's column, else one of
    ``documents``.  Ids are drawn by hash before any text is read, and the rows that fit are chosen by their sizes, so what is sorted,
    summed and broadcast are ``rows`` small rows whatever the tables' size; only chosen texts move, and meet in one task.  Where the
    drawn texts overrun the bytes, those of up to a hundredth of the bound fill it in drawn order; longer ones come last, the shortest
    first, so that only texts that do not fit are left out.  Rows that repeat an id and a text are chosen together.
    """
    order = [F.xxhash64(F.col("doc_id").cast("long"), F.lit(17)), F.col("doc_id")]
    source = documents if labels is None else labels
    keys = source.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    keys = keys.orderBy(*order).limit(rows).distinct()  # an id that stands in several rows is drawn once
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    key = ["doc_id", "label", "size", "digest"]
    sizes = texts.join(F.broadcast(keys), "doc_id").select("doc_id", "label", size.alias("size"), F.xxhash64("text").alias("digest"))
    sizes = sizes.filter(F.col("size") <= max_bytes).groupBy(*key).agg(F.count("*").alias("times"))
    drawn = [F.when(F.col("size") > F.lit(max_bytes / 100), F.col("size")).otherwise(0), *order, "label", "digest"]
    upto = Window.orderBy(*drawn).rowsBetween(Window.unboundedPreceding, 0)
    chosen = sizes.orderBy(*drawn).limit(rows).withColumns({"bytes": F.sum(F.col("size") * F.col("times")).over(upto), "rows": F.sum("times").over(upto)})
    chosen = chosen.filter((F.col("bytes") <= max_bytes) & (F.col("rows") <= rows)).select("doc_id", "label", "digest")
    found = texts.join(F.broadcast(chosen), "doc_id").filter(F.xxhash64("text") == F.col("digest"))
    return found.repartition(1).sortWithinPartitions(*order, "label", "text").select("text", "label")


def fitted(rows: DataFrame, fit: Callable[[list], object]) -> object:
    """``fit`` of a bounded sample, run in one task; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(held))], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])


def scored(documents: DataFrame, added: list[str], later: list[str], scorer: Callable) -> DataFrame:
    """Run an Arrow scorer over ``documents`` and keep its columns beside the scores.

    The scorer's batches hold the text first and then the columns to pass on.
    Columns named like one of ``added`` (DDL) or ``later`` are replaced.
    """
    taken = {a.split()[0].lower() for a in added} | {x.lower() for x in later}
    own = [c for c in documents.columns if c.lower() not in taken]
    kept = documents.select(*[F.col("`" + c.replace("`", "``") + "`") for c in own])
    # columns travel under plain names, as theirs may hold any characters
    plain = kept.toDF(*[f"c{n}" for n in range(len(own))])
    new = T._parse_datatype_string(", ".join(added)).fields
    text = plain[f"c{own.index('text')}"].cast("string").alias("t")
    got = plain.select(text, *plain.columns).mapInArrow(scorer, T.StructType([*plain.schema.fields, *new]))
    return got.toDF(*own, *[f.name for f in new])
