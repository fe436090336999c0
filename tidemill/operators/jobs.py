"""Jobs as a table: publish, claim, finish, drop and status; and waiting until documents are through.

A job id is taken while its job or its result is in the table.  Delivery is at least once: handlers are idempotent.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConflictError, JobTimeout
from . import tables

JOBS = "job_id string, task string, queue string, payload string, state string, attempts int, enqueued_at timestamp, finished_at timestamp, error string"
#: What a job's state may be; an id without a job is not_found.
QUEUED, RUNNING, COMPLETE, FAILED, NOT_FOUND = "queued", "in_progress", "complete", "failed", "not_found"


def taken(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of a batch that the table holds already or that the batch repeats."""
    known = new.select("job_id").join(jobs.select("job_id"), "job_id", "left_semi")
    again = new.groupBy("job_id").count().filter("count > 1").select("job_id")
    return known.unionByName(again).distinct()


def publish(jobs: DataFrame, new: DataFrame, now: Column, queue: str = "default") -> DataFrame:
    """``jobs`` with ``new`` (job_id, task, payload); an id that is taken refuses the whole batch, as no job would run for it."""
    held = [r["job_id"] for r in taken(jobs, new).orderBy("job_id").limit(10).collect()]
    if held:
        raise ConflictError(f"jobs {held} were not queued: their ids are taken", details={"job_ids": held})
    rows = new.select("job_id", "task", F.lit(queue).alias("queue"), "payload", F.lit(QUEUED).alias("state"), F.lit(0).alias("attempts"), now.alias("enqueued_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("error"))
    return jobs.unionByName(rows)


def claim(jobs: DataFrame, n: int | None, queue: str = "default") -> tuple[DataFrame, DataFrame]:
    """(jobs, the ``n`` oldest queued ones (None: all), which are now running and on their next attempt)."""
    ready = (F.col("queue") == queue) & (F.col("state") == QUEUED)
    if n is None:
        both = jobs.withColumn("_mine", ready)
    else:
        mine = jobs.filter(ready).orderBy("enqueued_at", "job_id").limit(n).select("job_id", F.lit(True).alias("_mine"))
        both = jobs.join(mine, "job_id", "left")
    after = both.withColumn("state", F.when(F.col("_mine"), RUNNING).otherwise(F.col("state"))).withColumn("attempts", F.col("attempts") + F.when(F.col("_mine"), 1).otherwise(0))
    return after.drop("_mine").select(*jobs.columns), after.filter("_mine").drop("_mine").select(*jobs.columns)


def finish(jobs: DataFrame, done: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """Record ``done`` (job_id, error): a job that failed is queued again until its attempts are used up."""
    both = jobs.join(done.select("job_id", F.col("error").alias("_error"), F.lit(True).alias("_done")), "job_id", "left")
    again = F.col("_error").isNotNull() & (F.col("attempts") < max_attempts)
    state = F.when(F.col("_done"), F.when(again, QUEUED).when(F.col("_error").isNotNull(), FAILED).otherwise(COMPLETE)).otherwise(F.col("state"))
    ended = F.when(F.col("_done") & ~again, now).otherwise(F.col("finished_at"))
    error = F.when(F.col("_done"), F.col("_error")).otherwise(F.col("error"))
    return both.select(*[{"state": state, "finished_at": ended, "error": error}.get(c, F.col(c)).alias(c) for c in jobs.columns])


def drop(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Forget jobs and their results, so that their ids are free; for recovery, not for running jobs."""
    return tables.delete_ids(jobs, ids, "job_id")


def status(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """What became of some ids: job_id, state, attempts, enqueued_at, finished_at, error."""
    found = ids.select("job_id").distinct().join(jobs.select("job_id", "state", "attempts", "enqueued_at", "finished_at", "error"), "job_id", "left")
    return found.withColumn("state", F.coalesce("state", F.lit(NOT_FOUND))).withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def await_documents(ledger: Callable[[], DataFrame], ids: Iterable[str], timeout_s: float = 600, every_s: float = 1, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> dict[str, str]:
    """Read the ledger again and again until every document is INDEXED or FAILED: their states.

    A document that the ledger does not know yet is waited for.  Raises JobTimeout with those still open.
    """
    wanted, until = sorted(set(ids)), clock() + timeout_s
    while True:
        rows = ledger().filter(F.col("doc_id").isin(wanted) & F.col("status").isin("INDEXED", "FAILED")).select("doc_id", "status").collect() if wanted else []
        found = {r["doc_id"]: r["status"] for r in rows}
        still = [i for i in wanted if i not in found]
        if not still:
            return found
        if clock() + every_s > until:
            raise JobTimeout(f"{len(still)} documents are not through after {timeout_s:g} s", details={"doc_ids": still})
        sleep(every_s)
