"""The life of each document on a stream: legal moves, retries of rate limits, and an end for what stands still.

Moves arrive as rows; a document's state (status, attempts, time of its last move) lives in Spark's state store, so a restart from the
checkpoint goes on where the last batch ended.  Documents are dealt by the hash of their id to buckets, whose states are read and written
at once: a call and its messages to the store are then for some documents, not for each one.  What a batch decides is appended as rows (doc_id, at, current, status, verdict,
error_code, attempts): the ledger is the last accepted row of each document, and can be made again from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import legal
from ..operators.tables import first_by

MOVES = "doc_id string, seq long, at timestamp, status string, error_code string"
VERDICTS = "doc_id string, at timestamp, current string, status string, verdict string, error_code string, attempts int"
STATE = "doc_id string, status string, attempts int, at_us long, seq long, kept_ms long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States in which a document waits for nobody.
RESTING = ("PENDING", "INDEXED", "FAILED", "DELETING")
RATE_LIMITED, TIMEOUT = "RATE_LIMITED", "JOB_TIMEOUT"
#: What the processor gives: VERDICTS with the time in microseconds.
MADE = VERDICTS.replace("at timestamp", "at_us long")
#: Buckets of documents; fixed as long as a checkpoint is used.
BUCKETS = 1024


@dataclass(frozen=True)
class Lifecycle:
    """``timeout_s``: how long a document may stay in a state of work.  ``max_attempts``: a rate limit sends a document back to PENDING
    until this many attempts have failed, then it fails for good; any other error fails it at once."""

    timeout_s: int = 3600
    max_attempts: int = 3

    def step(self, state: tuple | None, move: tuple) -> tuple[list[tuple], tuple | None]:
        """(verdict rows without the id, next state) of one move (seq, at, status, error_code) in a state (status, attempts, at, seq).

        Times are timestamps, or all of them whole microseconds.  A document begins with PENDING.  A move with a number that the state has seen (a row delivered again) gives nothing.
        """
        seq, at, wanted, error = move
        if state is None:
            ok = wanted == "PENDING"
            return [(at, None, wanted, "ok" if ok else "unknown", error, 0)], ((wanted, 0, at, seq) if ok else None)
        status, attempts, since, last = state
        if seq <= last:
            return [], state
        rows = []
        over = self.deadline(state)
        if over is not None and at > over:
            rows.append((over, status, "FAILED", "expired", TIMEOUT, attempts))
            status, since = "FAILED", over
        if wanted == "FAILED" and error == RATE_LIMITED and legal(status, "FAILED") and status != "FAILED":
            attempts += 1
            again = attempts < self.max_attempts
            rows.append((at, status, "PENDING" if again else "FAILED", "retry" if again else "ok", error, attempts))
            return rows, ("PENDING" if again else "FAILED", attempts, at, seq)
        if not legal(status, wanted):
            rows.append((at, status, wanted, "illegal", error, attempts))
            return rows, (status, attempts, since, seq)
        rows.append((at, status, wanted, "ok", error, attempts))
        return rows, (wanted, attempts, at, seq)

    def deadline(self, state: tuple | None):
        """When a document in a state of work has stood still for too long."""
        if state is None or state[0] in RESTING:
            return None
        return state[2] + (int(self.timeout_s * 1_000_000) if isinstance(state[2], int) else timedelta(seconds=self.timeout_s))


class _Processor(StatefulProcessor):
    """The moves of a bucket of documents; its one timer is that of the earliest deadline."""

    def __init__(self, rules: Lifecycle, ttl_ms: int | None):
        self.rules, self.ttl_ms = rules, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("documents", STATE, self.ttl_ms)

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.ttl_ms is None else timers.getCurrentProcessingTimeInMs()

    def _held(self, now: int) -> dict:
        """(status, attempts, at, seq) of each document, and when it was kept; what a time to live has ended is left out."""
        rows = ((r[0], (r[1], int(r[2]), int(r[3]), int(r[4])), int(r[5])) for r in self.state.get())
        return {doc: (state, kept) for doc, state, kept in rows if self.ttl_ms is None or now - kept < self.ttl_ms}

    def _due_ms(self, held: dict) -> int | None:
        return min((due // 1000 for state, _ in held.values() if (due := self.rules.deadline(state)) is not None), default=None)

    def _keep(self, held: dict, due: int | None) -> None:
        self.state.put([(doc, *state, kept) for doc, (state, kept) in held.items()])
        known = list(self.handle.listTimers())
        for t in known:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in known:
            self.handle.registerTimer(due)

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MADE.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moves = pd.concat(list(rows)).sort_values("seq", kind="stable")  # of one bucket in one batch
        now, out, step = self._now(timerValues), [], self.rules.step
        held = self._held(now)
        for doc, seq, at, wanted, error in zip(*(moves[c].tolist() for c in ("doc_id", "seq", "at_us", "status", "error_code")), strict=True):
            known = held.get(doc)
            made, state = step(None if known is None else known[0], (seq, at, wanted, error if isinstance(error, str) else None))
            out += [(doc, *r) for r in made]
            if state is not None:
                held[doc] = state, now
        if held:
            self._keep(held, self._due_ms(held))
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = self._now(timerValues), []
        held = self._held(now)
        for doc, (state, _) in held.items():
            due = self.rules.deadline(state)
            if due is not None and due // 1000 <= now:
                out.append((doc, due, state[0], "FAILED", "expired", TIMEOUT, state[1]))
                held[doc] = ("FAILED", state[1], due, state[3]), now
        if held:
            self._keep(held, self._due_ms(held))
        if out:
            yield self._rows(out)

    def close(self) -> None:
        pass


def moves_of(stream: DataFrame, rules: Lifecycle | None = None, late: str = "0 seconds", ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``stream`` of MOVES (``seq`` ascends with a document's moves): VERDICTS, appended as they are decided.

    ``late`` is how long the watermark waits; a document that stands still is failed once the watermark has passed its deadline, or by its
    next move if that comes first, with the same row.  ``ttl_ms`` lets the state of documents that never move again go.  A batch reads and writes
    the whole ``buckets`` that its documents are in, so there should be some for each hundred documents; their number stays as it is for the
    life of a checkpoint.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    dated = stream.withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    mode = "EventTime" if ttl_ms is None else "ProcessingTime"
    dealt = dated.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).groupBy("bucket")
    made = dealt.transformWithStateInPandas(_Processor(rules or Lifecycle(), ttl_ms), MADE, "Append", mode)
    return made.select("doc_id", F.timestamp_micros("at_us").alias("at"), "current", "status", "verdict", "error_code", "attempts")


def run_moves(spark: SparkSession, arrivals: str, out: str, checkpoint: str, rules: Lifecycle | None = None, late: str = "0 seconds", files: int = 1, buckets: int = BUCKETS):
    """Replay Parquet files of MOVES as they arrived, ``files`` a batch, into a table of verdicts; returns the started query."""
    stream = spark.readStream.schema(MOVES).option("maxFilesPerTrigger", files).parquet(arrivals)
    return moves_of(stream, rules, late, buckets=buckets).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def ledger_of(verdicts: DataFrame) -> DataFrame:
    """The last accepted state of each document: doc_id, status, error_code, attempts, updated_at."""
    accepted = verdicts.filter("verdict NOT IN ('illegal', 'unknown')")
    order = [F.desc("at"), (F.col("verdict") == "expired").asc(), F.desc("attempts"), "status"]
    return first_by(accepted, ["doc_id"], order).select("doc_id", "status", "error_code", "attempts", F.col("at").alias("updated_at"))
