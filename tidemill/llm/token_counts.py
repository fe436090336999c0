"""Token counts by a digest cache.

A text's SHA-256 and the tokenizer's version (SHA-256 of its file) name its count in a table.  Texts are joined
with that table by digest; only distinct misses are encoded, and their counts are appended to it, each run's in a
folder of its own.  Runs at the same time may therefore store a digest twice; it counts once.  Content is normalised only
as far as every tokenizer must agree on: null becomes the empty text.

Edge cases: null and empty texts have no bytes and no tokens; repeated rows and copies are encoded once and
each reported, also without an id; texts are never cut; other columns are ignored.  Copies in any number meet in one row by
partial aggregation, and the join that gives counts back moves digests only, no text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import chunks
from .storage import exists, materialize, new_path
from .tokens import counter, file_digest

CACHE = "digest string, tokenizer string, n_tokens long"


def _encode(path: str, version: str):
    schema = pa.schema([("digest", pa.string()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for lo, hi, _, _ in chunks(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.string()), pa.array([version] * len(texts)), pa.array(count(texts), pa.int64())], schema=schema)

    return run


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) of one tokenizer that a cache holds now; None where there is no cache."""
    if not exists(spark, cache):
        return None
    return spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")


def count_tokens(documents: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """``documents`` (doc_id, text): n_bytes, n_tokens and over_limit of each row.

    ``tokenizer`` is a path of a .model or .json file that executors can read; ``cache`` is the table's folder in
    a store that all executors share, created when absent; without one a new folder is used.
    """
    spark = documents.sparkSession
    version = file_digest(tokenizer)
    cache = cache or new_path(spark, "token-counts")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.select("doc_id", text.alias("text")).select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    known = stored(spark, cache, version)
    misses = keyed if known is None else keyed.join(known.select("digest").distinct(), "digest", "left_anti")
    misses = misses.groupBy("digest").agg(F.first("text").alias("text"))
    own = f"{cache}/run={uuid.uuid4().hex}"
    misses.mapInArrow(_encode(tokenizer, version), CACHE).write.parquet(own)
    counts = spark.read.schema(CACHE).parquet(own).select("digest", "n_tokens")
    if known is not None:  # as a table, so that a digest of very many rows can be split in the join below
        counts = materialize(counts.unionByName(known).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return (
        keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
        .join(counts, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
