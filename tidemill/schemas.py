"""DDL of the engine's tables, and checks on their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import ConflictError, ValidationError

STATUSES = ("PENDING", "PARSING", "EMBEDDING", "EXTRACTING", "RESOLVING", "INDEXED", "FAILED", "DELETING")
STRATEGIES = ("vector", "graph", "hybrid")

SOURCE = "struct<doc_id: string, uri: string, page: int, char_start: int, char_end: int, ingested_at: timestamp>"
LEDGER = "doc_id string, uri string, sha256 string, mime_type string, status string, error_code string, attempts int, corpus_version long, created_at timestamp, updated_at timestamp"
CHUNKS = "chunk_id string, text string, content_hash string, schema_version int"
CHUNK_SOURCES = "chunk_id string, doc_id string, uri string, page int, char_start int, char_end int, ingested_at timestamp"
CHUNK_REPEATS = "chunk_id string, doc_id string, page int, char_start int, char_end int"
HAS_CHUNK = "doc_id string, chunk_id string, ord int, page int, char_start int, char_end int"
MENTIONS = "chunk_id string, surface string, type string, char_start int, char_end int, confidence double, entity_id string"
RELATIONS_RAW = "chunk_id string, src_surface string, dst_surface string, type string, confidence double, evidence_span string"
ENTITIES = "canonical_id string, name string, name_normalized string, type string, aliases array<string>, mention_count long"
RELATES = "src_id string, dst_id string, type string, confidence double, chunk_id string, doc_id string, evidence_span string"
ALIASES = "alias_id string, canonical_id string, score double, method string"
FLAGGED = "a_id string, b_id string, score double"
TRAIL = "at timestamp, source string, level string, message string, attributes map<string, string>, trace_id string, span_id string"
GOLDEN = "id string, question string, category string, gold_route string, gold_chunk_ids array<string>, gold_answer string, must_refuse boolean"
EVAL_RESULTS = "item_id string, category string, question string, answer string, predicted_route string, retrieved array<string>, confidence double, refused boolean, error string"
PLAN = "struct<strategy: string, template: string, seed_entities: array<string>, hops: int, relation_type: string, sub_queries: array<string>, rationale: string>"


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, whose evaluation fails at the first row where ``condition`` is not true.

    The check is a filter, so that no later projection can prune it away.
    """
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def assert_columns(df: DataFrame, ddl: str, name: str) -> DataFrame:
    """``df`` if it has the columns of ``ddl`` with their types; a table of another shape raises."""
    want = {f.name: f.dataType.simpleString() for f in df.sparkSession.createDataFrame([], ddl).schema.fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = {k: (have.get(k), v) for k, v in want.items() if have.get(k) != v}
    if wrong:
        raise ConflictError(f"{name} has another shape", details={"columns": wrong})
    return df


#: Tables of a store, by name; a sparse index is its terms together with their inverse frequencies.
STORED = {"ledger": LEDGER, "chunks": CHUNKS, "registry": CHUNK_SOURCES, "entities": ENTITIES, "aliases": ALIASES, "mentions": MENTIONS, "relates": RELATES, "terms": "chunk_id string, term string, tf double", "idf": "term string, df long, idf double"}


def set_up(store, schemas: dict[str, str] | None = None) -> list[str]:
    """Make a store's missing tables, empty, and check those it has; the names of the new ones.

    Running it again makes nothing.  A table of another shape raises ConflictError, and so do terms that hold rows
    where there are no frequencies, since their scores would not be weighted.
    """
    made = []
    for name, ddl in (schemas or STORED).items():
        if store.versions(name):
            assert_columns(store.stored(name), ddl, name)
        else:
            if name == "idf" and store.versions("terms") and "terms" not in made and store.stored("terms").limit(1).count():
                raise ConflictError("the sparse index has terms but no inverse frequencies")
            store.write(name, store.spark.createDataFrame([], ddl))
            made.append(name)
    return made


def check_width(df: DataFrame, column: str, dimensions: int) -> DataFrame:
    """Every vector has the index's width."""
    return checked(df, F.col(column).isNull() | (F.size(column) == dimensions), f"vectors of {column} must have {dimensions} components")


def check_sparse(df: DataFrame, indices: str, values: str) -> DataFrame:
    """Indices are unique and ascending, and there is one value for each; both may be empty."""
    ok = (F.size(indices) == F.size(values)) & (F.col(indices) == F.sort_array(F.array_distinct(indices)))
    return checked(df, ok, "sparse vectors need aligned, unique and ascending indices")


def check_member(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    if not values:
        raise ValidationError("no values to check against")
    return checked(df, F.col(column).isin(*values), f"{column} must be one of {', '.join(values)}")
