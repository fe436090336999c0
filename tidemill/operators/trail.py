"""Time-ordered trail of log lines and spans, with secrets covered and long fields cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Trail
from ..functions.scalars import epoch_ns, redact_map, status_level

FIELDS = ["at", "source", "level", "message", "attributes", "trace_id", "span_id"]
LINE = "map<string, string>"


def log_events(lines: DataFrame) -> DataFrame:
    """``lines`` (ts_ns, line): parsed JSON objects; any other line is its own message."""
    parsed = lines.withColumn("f", F.when(F.get_json_object("line", "$").startswith("{"), F.from_json("line", LINE)))
    f = F.coalesce("f", F.create_map(F.lit("event"), F.col("line")))
    both = parsed.withColumn("f", f)
    text = lambda k: F.when(F.element_at("f", F.lit(k)) != "", F.element_at("f", F.lit(k)))
    out = F.col("f").getItem
    rest = F.map_filter("f", lambda k, v: ~k.isin("event", "message", "level", "timestamp") | ((k == "message") & text("event").isNotNull()))
    return both.select(epoch_ns(F.col("ts_ns")).alias("at"), F.lit("log").alias("source"), F.upper(F.coalesce(out("level"), F.lit("info"))).alias("level"), F.coalesce(text("event"), text("message"), "line").alias("message"), rest.alias("attributes"), out("trace_id").alias("trace_id"), out("span_id").alias("span_id"))


_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>"
_SPAN = f"struct<spanId: string, name: string, startTimeUnixNano: string, attributes: array<struct<key: string, value: {_VALUE}>>, status: struct<code: string>>"
OTLP = f"resourceSpans array<struct<scopeSpans: array<struct<spans: array<{_SPAN}>>>>>"


def span_events(traces: DataFrame) -> DataFrame:
    """``traces`` (trace_id, body): OTLP JSON, flattened to one row for each span."""
    parsed = traces.select("trace_id", F.from_json("body", OTLP).alias("t"))
    spans = parsed.select("trace_id", F.explode("t.resourceSpans").alias("r")).select("trace_id", F.explode("r.scopeSpans").alias("s")).select("trace_id", F.explode("s.spans").alias("p"))
    named = F.filter(F.coalesce("p.attributes", F.array().cast(f"array<struct<key: string, value: {_VALUE}>>")), lambda a: a["key"].isNotNull())
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    attributes = F.map_from_entries(F.transform(named, lambda a: F.struct(a["key"], value(a["value"]))))
    return spans.select(epoch_ns(F.col("p.startTimeUnixNano")).alias("at"), F.lit("span").alias("source"), status_level(F.col("p.status.code")).alias("level"), F.coalesce("p.name", F.lit("")).alias("message"), attributes.alias("attributes"), "trace_id", F.col("p.spanId").alias("span_id"))


def in_window(df: DataFrame, correlation_id: str | Column, now: Column, rules: Trail, column: str = "correlation_id", at: str = "at") -> DataFrame:
    """The rows of one correlation id within the look-back."""
    return df.filter((F.col(column) == correlation_id) & (F.col(at) <= now) & (F.col(at) >= now - F.expr(f"interval {rules.lookback_h} hours")))


def sanitized(events: DataFrame, rules: Trail) -> DataFrame:
    cut = F.transform_values(redact_map(F.col("attributes"), rules), lambda _, v: F.substring(v, 1, rules.truncate_chars))
    return events.withColumn("attributes", cut).withColumn("message", F.substring("message", 1, rules.truncate_chars))


def merged(sources: list[DataFrame], rules: Trail, group: tuple[str, ...] = ()) -> DataFrame:
    """Events of all sources by time, numbered, capped; ``truncated`` tells whether the cap cut any."""
    both = reduce(DataFrame.unionByName, [s.select(*group, *FIELDS) for s in sources])
    order = ["at", "source", "span_id", "message"]
    if not group:  # one trail: its first events by a distributed top-k, so that the window below is small
        both = both.orderBy(*order).limit(rules.max_events + 1)
    window = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    numbered = both.withColumn("n", F.row_number().over(window.orderBy(*order)))
    # one row beyond the cap is enough to know that it was reached
    numbered = numbered.filter(F.col("n") <= rules.max_events + 1)
    numbered = numbered.withColumn("truncated", F.max("n").over(window) > rules.max_events)
    return sanitized(numbered.filter(F.col("n") <= rules.max_events), rules)


def build(loaders: dict, rules: Trail) -> tuple[DataFrame | None, list[str]]:
    """Merge what can be loaded: (events, names of sources that failed).  A dead source never fails the trail."""
    alive, dead = [], []
    for name, load in loaders.items():
        try:
            df = load()
            df.schema  # noqa: B018  analysis errors show here
            alive.append(df)
        except Exception:
            dead.append(name)
    return (merged(alive, rules) if alive else None), dead


def to_markdown(correlation_id: str, events: list, settings_digest: str, failed: list[str]) -> str:
    """The trail of one id for reading: header, timeline, errors in full."""
    spans = sum(e["source"] == "span" for e in events)
    traces = sorted({e["trace_id"] for e in events if e["trace_id"]})
    cell = lambda t: t.replace("|", r"\|").replace("\n", " ")
    head = [f"# Trail of {correlation_id}", "", f"- settings: {settings_digest}", f"- traces: {', '.join(traces) or 'none'}", f"- events: {len(events)} ({spans} spans, {len(events) - spans} logs)", f"- truncated: {any(e['truncated'] for e in events)}", f"- failed sources: {', '.join(failed) or 'none'}"]
    table = ["", "| time | source | level | message |", "|---|---|---|---|", *(f"| {e['at'].isoformat()} | {e['source']} | {e['level']} | {cell(e['message'])} |" for e in events)]
    bad = [e for e in events if e["level"] in ("ERROR", "CRITICAL")]
    detail = [x for e in bad for x in ("", f"## {e['at'].isoformat()} {e['source']} {e['level']}", "", e["message"], "", *(f"- {k}: {v}" for k, v in sorted((e["attributes"] or {}).items())))]
    return "\n".join([*head, *table, *detail])
