"""Counters and histograms, taken from the plans that run anyway.

A table passes through ``watch`` and is counted by ``DataFrame.observe`` while its action runs, so no extra pass is made.
"""

from __future__ import annotations

import functools
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The instruments and what they measure.
COUNTERS = {
    "route_selected": "routes that plans chose, by strategy",
    "answer_refused": "refusals, by reason",
    "citations_invalid": "citations of chunks that were not given",
    "llm_tokens": "tokens, by role and direction",
    "llm_rate_limited": "refused calls, by provider",
    "ingest_chunks_deduped": "chunks that were known already",
    "entities_merged": "merge decisions, by band",
    "grader_degraded": "batches kept whole because a grade was missing",
}
HISTOGRAMS = {"retrieval_latency": "milliseconds, by backend", "repair_attempts": "repairs of a structured call", "projection_lag": "milliseconds of a projection"}
#: Upper ends of a histogram's buckets; one more holds the rest.
BUCKETS = (1, 5, 10, 50, 100, 500, 1000, 5000, 10000)

#: The id that ties a request's rows, logs and metrics together.
correlation: ContextVar[str] = ContextVar("correlation", default="")


def correlated(f: Callable) -> Callable:
    """Run under the caller's correlation id, or under a new one."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        token = None if correlation.get() else correlation.set(uuid.uuid4().hex)
        try:
            return f(*args, **kwargs)
        finally:
            if token is not None:
                correlation.reset(token)

    return run


class Metrics:
    """All instruments, injected where something is measured."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], float] = defaultdict(float)
        self.buckets: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0] * (len(BUCKETS) + 1))
        self._open: list[tuple[str, dict[str, str], Observation]] = []

    @staticmethod
    def _known(name: str, kind: dict) -> None:
        if name not in kind:
            raise KeyError(f"{name} is no instrument of this kind")

    def add(self, name: str, amount: float = 1, label: str = "") -> None:
        self._known(name, COUNTERS)
        self.counts[name, label] += amount

    def record(self, name: str, value: float, label: str = "") -> None:
        self._known(name, HISTOGRAMS)
        self.buckets[name, label][next((n for n, top in enumerate(BUCKETS) if value <= top), len(BUCKETS))] += 1

    def watch(self, df: DataFrame, name: str, amount: Column | None = None, by: str | None = None, labels: Iterable[str] = ()) -> DataFrame:
        """``df``, whose rows (or ``amount`` of each) are added to a counter when an action runs over it.

        With ``by`` the rows of each of the ``labels`` of that column are counted apart; others count as "other".
        """
        self._known(name, COUNTERS)
        each = amount if amount is not None else F.lit(1)
        named = {f"m{n}": label for n, label in enumerate(labels)}
        sums = {m: F.col(by) == label for m, label in named.items()} if by else {}
        other = ~F.coalesce(F.col(by).isin(*named.values()), F.lit(False)) if by else F.lit(True)
        own = Observation(f"{name}-{uuid.uuid4().hex}")
        columns = [F.sum(F.when(c, each).otherwise(0)).alias(m) for m, c in sums.items()]
        self._open.append((name, named | {"rest": "other" if by else ""}, own))
        return df.observe(own, *columns, F.sum(F.when(other, each).otherwise(0)).alias("rest"))

    def collect(self) -> dict[str, dict[str, float]]:
        """Counters by name and label; waits for the tables under watch, of which an action must have run over each."""
        for name, labels, own in self._open:
            for m, amount in own.get.items():
                if amount:
                    self.add(name, amount, labels[m])
        self._open.clear()
        out: dict[str, dict[str, float]] = {}
        for (name, label), amount in self.counts.items():
            out.setdefault(name, {})[label] = amount
        return out

    def timed(self, name: str, label: str = "") -> Callable:
        """Record how many milliseconds a call takes, also where it fails."""

        def wrap(f: Callable) -> Callable:
            @functools.wraps(f)
            def run(*args, **kwargs):
                began = time.perf_counter()
                try:
                    return f(*args, **kwargs)
                finally:
                    self.record(name, (time.perf_counter() - began) * 1000, label)

            return run

        return wrap
