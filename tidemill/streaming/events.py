"""Progress of queries as server-sent events, from states in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_text(kind: Column, data: Column, number: Column) -> Column:
    """One event: its id, its kind, its data line by line, and the blank line that ends it."""
    lines = F.transform(F.split(data, r"\r\n|\r|\n", -1), lambda x: F.concat(F.lit("data: "), x))
    return F.concat(F.lit("id: "), number.cast("string"), F.lit("\n"), F.lit("event: "), kind, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


def sse(events: DataFrame) -> DataFrame:
    """``events`` (query_id, seq, kind, data as JSON or text): query_id, seq and the event as it is sent.

    A null data is an event without content.
    """
    return events.select("query_id", "seq", event_text(F.col("kind"), F.coalesce("data", F.lit("")), F.col("seq")).alias("event"))


def node_events(states: DataFrame) -> DataFrame:
    """``states`` (query_id, seq, next, state as JSON) as events: the node that comes next, at the end the answer or the error."""
    j = lambda p: F.get_json_object("state", p)
    kind = F.when(F.col("next") == "end", "answer").when(F.col("next") == "error", "error").otherwise("node")
    data = F.when(F.col("next") == "end", j("$.answer")).when(F.col("next") == "error", j("$.error")).otherwise(F.to_json(F.struct(F.col("next").alias("node"))))
    return sse(states.select("query_id", "seq", kind.alias("kind"), data.alias("data")))
