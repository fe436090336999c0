import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemill.config import Trail
from tidemill.operators import trail as T


def logs(spark):
    lines = [(1_000_000_000, json.dumps({"event": "began", "level": "info", "api_key": "x", "trace_id": "t"})), (3_000_000_000, "not json"), (5_000_000_000, json.dumps({"message": "m", "level": "error", "note": "sk-1", "timestamp": "z"})), (6_000_000_000, "[1]")]
    return T.log_events(spark.createDataFrame(lines, "ts_ns long, line string"))


def spans(spark):
    span = {"spanId": "s", "name": "step", "startTimeUnixNano": "2000000000", "attributes": [{"key": "n", "value": {"intValue": "7"}}, {"value": {}}], "status": {"code": 2}}
    body = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]})
    return T.span_events(spark.createDataFrame([("t", body)], "trace_id string, body string"))


def test_merge_is_ordered_and_clean(spark):
    rows = T.merged([logs(spark), spans(spark)], Trail()).orderBy("n").collect()
    assert [r.message for r in rows] == ["began", "step", "not json", "m", "[1]"]
    assert [r.level for r in rows] == ["INFO", "ERROR", "INFO", "ERROR", "INFO"] and not rows[0].truncated
    assert rows[0].attributes == {"api_key": "**********", "trace_id": "t"} and rows[3].attributes == {"note": "**********"} and rows[1].attributes == {"n": "7"}
    text = T.to_markdown("cid", [r.asDict() for r in rows], "digest", ["loki"])
    assert "5 (1 spans, 4 logs)" in text and "failed sources: loki" in text and text.count("## ") == 2


def test_cap_is_told(spark):
    rows = T.merged([logs(spark), spans(spark)], Trail(max_events=2, truncate_chars=3)).collect()
    assert len(rows) == 2 and all(r.truncated for r in rows) and {r.message for r in rows} == {"beg", "ste"}
    assert not any(r.truncated for r in T.merged([spans(spark)], Trail(max_events=1)).collect())


def test_a_dead_source_is_named(spark):
    events, dead = T.build({"logs": lambda: logs(spark), "spans": lambda: spark.table("nowhere")}, Trail())
    assert dead == ["spans"] and events.count() == 4
    assert T.build({"spans": lambda: spark.table("nowhere")}, Trail()) == (None, ["spans"])


def test_look_back(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 2)), ("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 2))], "correlation_id string, at timestamp")
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert T.in_window(rows, "a", now, Trail()).count() == 1
