"""Streams: documents that arrive as files, and windows over events.

Delivery is at least once; keys make it idempotent.  One query owns a table, so its snapshots follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..plans.ingest import CHUNK_TABLE, TERM_TABLE, Corpus, added
from ..schemas import CHUNK_REPEATS, CHUNK_SOURCES, LEDGER
from ..sources.readers import Snapshots

ARRIVALS = "doc_id string, uri string, text string, mime_type string, sha256 string"
#: Tables that only grow: a batch writes what it adds.
GROWING = {"chunks": CHUNK_TABLE, "terms": TERM_TABLE, "registry": CHUNK_SOURCES, "repeats": CHUNK_REPEATS}
#: Ledgers kept for readers that began before the last batch.
KEPT = 10


def read_corpus(store: Snapshots) -> Corpus:
    """The corpus as of the last complete ledger; rows of a batch that was lost before its ledger are not seen."""
    version = (store.versions("ledger") or [0])[-1]
    return Corpus(store.read("ledger", LEDGER), *(store.read_until(name, schema, version) for name, schema in GROWING.items()), version=version)


def ingest_stream(spark: SparkSession, arrivals: str, store: Snapshots, checkpoint: str, embed: Callable[[Column], Column], settings: Settings | None = None, now: Column | None = None):
    """Ingest JSON files as they arrive in a folder; returns the started query.

    A batch writes the rows that it adds and the next ledger, which is one row a document.  A batch that is replayed
    after a loss finds its documents in the ledger and adds nothing, or writes its rows over those it left.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        corpus = read_corpus(store)
        new = added(corpus, rows.dropDuplicates(["sha256"]), embed, settings, now)
        for name in GROWING:
            store.add(name, getattr(new, name), new.version)
        store.write("ledger", new.ledger)  # the last: it makes the batch known
        store.expire("ledger", KEPT)

    stream = spark.readStream.schema(ARRIVALS).json(arrivals)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str | None = None, at: str = "ts") -> DataFrame:
    """Counts and sums of values by window and type; ``late`` bounds state when events are a stream."""
    rows = events.withWatermark(at, late) if late else events
    window = F.window(F.col(at), length, slide) if slide else F.window(F.col(at), length)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, at: str = "ts") -> DataFrame:
    """Sessions of each user: their start, end and number of events."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.session_window(F.col(at), gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
