"""Ingestion: parse, chunk, name, deduplicate, embed what is new, register sources; and its reverse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.identity import content_hash, uuid_of
from ..functions.text import normalize_display
from ..operators import ledger as ledgers
from ..operators import provenance, tables
from ..operators.chunking import chunk
from ..session import small_batches
from ..shared import materialize
from ..operators.search import term_frequencies


@dataclass(frozen=True)
class Corpus:
    """The engine's tables at one version."""

    ledger: DataFrame
    chunks: DataFrame  # chunk_id, text, content_hash, schema_version, dense
    terms: DataFrame  # chunk_id, term, tf
    registry: DataFrame  # chunk_id, doc_id, uri, page, char_start, char_end, ingested_at: the first place of a chunk in a document
    repeats: DataFrame  # chunk_id, doc_id, page, char_start, char_end: its further places in that document
    version: int = 0


CHUNK_TABLE = "chunk_id string, text string, content_hash string, schema_version int, dense array<float>"
TERM_TABLE = "chunk_id string, term string, tf double"


def empty_corpus(spark) -> Corpus:
    from ..schemas import CHUNK_REPEATS, CHUNK_SOURCES, LEDGER

    return Corpus(*(spark.createDataFrame([], s) for s in (LEDGER, CHUNK_TABLE, TERM_TABLE, CHUNK_SOURCES, CHUNK_REPEATS)))


def named_chunks(documents: DataFrame, settings: Settings) -> DataFrame:
    """Each document's chunks: doc_id, uri, chunk_id, content_hash, ord, nth, place, text; a repeat within the document has no text."""
    display = documents.withColumn("text", normalize_display(F.col("text")))
    cut = chunk(display, settings.chunking).withColumn("content_hash", content_hash(F.col("text"))).withColumn("chunk_id", uuid_of(F.col("content_hash")))
    return provenance.occurrences(cut).withColumn("text", F.when(F.col("nth") == 1, F.col("text")))


def added(corpus: Corpus, documents: DataFrame, embed: Callable[[Column], Column], settings: Settings | None = None, now: Column | None = None) -> Corpus:
    """What ``ingest`` adds: new chunks, terms, sources and repeats alone, and the whole next ledger.

    Documents whose content is known are left alone.  A chunk is embedded once however many documents hold it.  A new
    document, whether it has chunks or not, walks every state of the ledger on its way to INDEXED.
    """
    settings, now = settings or Settings(), now if now is not None else F.current_timestamp()
    small_batches(documents.sparkSession)
    ledger, marked = ledgers.register(corpus.ledger, documents.select("doc_id", "uri", "sha256", "mime_type"), now)
    inserted = marked.filter("inserted").select("doc_id", "uri")
    fresh = documents.join(inserted, ["doc_id", "uri"], "left_semi")
    placed = materialize(named_chunks(fresh.drop("mime_type", "sha256"), settings), "chunks-of-documents")
    own, repeats = placed.filter("nth = 1"), placed.filter("nth > 1")
    unseen = tables.new_rows(corpus.chunks, own.select("chunk_id", "text", "content_hash"), ["chunk_id"], ["text"])
    unseen = materialize(unseen.select("chunk_id", "text", "content_hash", F.lit(1).alias("schema_version"), embed(F.col("text")).alias("dense")), "new-chunks")
    sources = own.select("chunk_id", "doc_id", "uri", "page", "char_start", "char_end", now.alias("ingested_at"))
    sources = tables.new_rows(corpus.registry, sources, ["chunk_id", "doc_id"], ["char_start", "char_end"])
    return Corpus(
        materialize(ledgers.advance(ledger, inserted, "INDEXED", now, corpus.version + 1), "ledger"),
        unseen,
        materialize(term_frequencies(unseen), "new-terms"),
        materialize(sources.select(*corpus.registry.columns), "new-sources"),
        repeats.select(*corpus.repeats.columns),
        corpus.version + 1,
    )


def ingest(corpus: Corpus, documents: DataFrame, embed: Callable[[Column], Column], settings: Settings | None = None, now: Column | None = None) -> Corpus:
    """Add parsed documents (doc_id, uri, text, mime_type, sha256 and optionally page_offsets).

    Running it again with the same documents changes nothing but the version.
    """
    new = added(corpus, documents, embed, settings, now)
    return replace(new, chunks=corpus.chunks.unionByName(new.chunks), terms=corpus.terms.unionByName(new.terms), registry=corpus.registry.unionByName(new.registry), repeats=corpus.repeats.unionByName(new.repeats))


def delete(corpus: Corpus, doc_id: str, now: Column | None = None) -> Corpus:
    """Take a document out; chunks that it alone held go, its ledger row stays as DELETING."""
    now = now if now is not None else F.current_timestamp()
    registry, touched = provenance.remove_document(corpus.registry, doc_id)
    registry = materialize(registry)
    gone = materialize(provenance.orphans(touched, registry))
    change = corpus.ledger.filter(F.col("doc_id") == doc_id).select("doc_id", F.lit("DELETING").alias("status"), F.lit(None).cast("string").alias("error_code"))
    return replace(corpus, ledger=materialize(ledgers.set_status(corpus.ledger, change, now)), chunks=tables.delete_ids(corpus.chunks, gone, "chunk_id"), terms=tables.delete_ids(corpus.terms, gone, "chunk_id"), registry=registry, repeats=provenance.remove_document(corpus.repeats, doc_id)[0], version=corpus.version + 1)


def reindex(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """Rebuild every chunk's sources from the registry: (chunks with sources, orphans)."""
    return provenance.project(corpus.chunks, corpus.registry, corpus.chunks.select("chunk_id"))
