"""The ledger of documents: a state machine, insert-once by content, and the corpus version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import STATUSES, checked
from . import tables

# The legal moves. Every state but the last may also move to DELETING, and any state to itself.
FORWARD = {
    "PENDING": ("PARSING", "FAILED"),
    "PARSING": ("EMBEDDING", "FAILED"),
    "EMBEDDING": ("EXTRACTING", "FAILED"),
    "EXTRACTING": ("RESOLVING", "FAILED"),
    "RESOLVING": ("INDEXED", "FAILED"),
    "INDEXED": (),
    "FAILED": ("PENDING",),
    "DELETING": (),
}


def legal(current: str, wanted: str) -> bool:
    return wanted in (current, *FORWARD[current]) or (wanted == "DELETING" and current != "DELETING")


def transitions(spark) -> DataFrame:
    """All legal (from, to) pairs: at most 64 rows."""
    return spark.createDataFrame([(a, b) for a in STATUSES for b in STATUSES if legal(a, b)], "current string, wanted string")


def register(ledger: DataFrame, uploads: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(ledger with new documents, uploads with inserted?): content that is known in any state is not inserted."""
    fresh = tables.new_rows(ledger, uploads, ["sha256"], ["doc_id", "uri"]).select(
        "doc_id", "uri", "sha256", "mime_type", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("error_code"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("corpus_version"), now.alias("created_at"), now.alias("updated_at")
    )
    marked = uploads.join(fresh.select("doc_id", "uri", "sha256").withColumn("inserted", F.lit(True)), ["doc_id", "uri", "sha256"], "left")
    return ledger.unionByName(fresh), marked.withColumn("inserted", F.coalesce("inserted", F.lit(False)))


def judged(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Each change with what the ledger says: current status and one of ok, unknown, illegal."""
    moves = F.broadcast(transitions(ledger.sparkSession)).withColumn("_legal", F.lit(True))
    known = changes.join(ledger.select("doc_id", F.col("status").alias("current")), "doc_id", "left")
    ruled = known.join(moves.withColumnRenamed("wanted", "status"), ["current", "status"], "left")
    return ruled.withColumn("verdict", F.when(F.col("current").isNull(), "unknown").when(F.col("_legal"), "ok").otherwise("illegal")).drop("_legal")


def set_status(ledger: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Apply (doc_id, status, error_code); an unknown document or an illegal move fails the batch."""
    ruled = checked(judged(ledger, changes), F.col("verdict") == "ok", "illegal or unknown document transition")
    new = ruled.select("doc_id", F.col("status").alias("_status"), F.col("error_code").alias("_error"), F.lit(True).alias("_hit"))
    # Left from the changes as well: a change without a ledger row must reach the check above.
    both = ledger.join(new, "doc_id", "full_outer")
    pick = lambda c, v: F.when(F.col("_hit"), v).otherwise(F.col(c)).alias(c)
    return both.select(*[pick(c, {"status": F.col("_status"), "error_code": F.col("_error"), "updated_at": now}[c]) if c in ("status", "error_code", "updated_at") else c for c in ledger.columns])


def route(current: str, wanted: str) -> tuple[str, ...] | None:
    """The legal moves from one state to a later one, one after the other; None where there are none."""
    paths = [(current,)]
    for path in paths:
        if path[-1] == wanted:
            return path[1:]
        paths += [(*path, s) for s in FORWARD[path[-1]] if s not in path and s != "FAILED"]
    return None


def advance(ledger: DataFrame, ids: DataFrame, wanted: str, now, version: int) -> DataFrame:
    """Take documents through every state between theirs and ``wanted``, and note the corpus version.

    An unknown document, or one from whose state no legal moves lead there, fails the batch; one that is there stays.
    """
    spark = ledger.sparkSession
    reach = spark.createDataFrame([(s, len(r)) for s in STATUSES if (r := route(s, wanted)) is not None], "status string, _steps int")
    mine = ids.select("doc_id").distinct().withColumn("_mine", F.lit(True))
    both = ledger.join(mine, "doc_id", "full_outer").join(F.broadcast(reach), "status", "left")
    both = checked(both, F.col("_mine").isNull() | F.col("_steps").isNotNull(), "illegal or unknown document transition")
    moved = F.col("_mine") & (F.col("_steps") > 0)
    new = {"status": F.lit(wanted), "updated_at": now, "corpus_version": F.lit(version).cast("long")}
    return both.select(*[F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in ledger.columns])


def purge(ledger: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger without some documents, their ids with existed?)."""
    known = ids.select("doc_id").distinct().join(ledger.select("doc_id", F.lit(True).alias("existed")), "doc_id", "left")
    return tables.delete_ids(ledger, ids, "doc_id"), known.withColumn("existed", F.coalesce("existed", F.lit(False)))


def purge_for_force(ledger: DataFrame, uploads: DataFrame) -> DataFrame:
    """A forced ingest forgets documents of the same content that did not get through."""
    stale = ledger.filter("status <> 'INDEXED'").join(uploads.select("sha256").distinct(), "sha256", "left_semi")
    return tables.delete_ids(ledger, stale, "doc_id")


class CorpusVersion:
    """A counter that only grows; absent, it reads 0.  One writer owns it (the streaming query or the batch job)."""

    def __init__(self, value: int = 0):
        self._value = value

    def current(self) -> int:
        return self._value

    def bump(self) -> int:
        self._value += 1
        return self._value
