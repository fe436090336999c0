"""The stream of moves against the same steps in plain order."""

import datetime

import pandas as pd
import pytest

from tidemill.streaming.lifecycle import MOVES, VERDICTS, Lifecycle, ledger_of, run_moves

START = datetime.datetime(2026, 1, 1)
RULES = Lifecycle(timeout_s=3600, max_attempts=2)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


MADE = [
    # a goes through; b is rate limited once and then for good; c stands still; d makes illegal moves; e is unknown
    ("a", 1, at(0), "PENDING", None), ("a", 2, at(1), "PARSING", None), ("b", 3, at(1), "PENDING", None), ("b", 4, at(2), "PARSING", None),
    ("b", 5, at(3), "FAILED", "RATE_LIMITED"), ("c", 6, at(3), "PENDING", None), ("c", 7, at(4), "PARSING", None), ("d", 8, at(5), "PENDING", None), ("d", 9, at(6), "INDEXED", None),
    ("e", 10, at(7), "PARSING", None),
    ("a", 11, at(20), "EMBEDDING", None), ("a", 12, at(21), "EXTRACTING", None), ("b", 13, at(21), "PARSING", None), ("b", 14, at(22), "FAILED", "RATE_LIMITED"), ("d", 15, at(23), "FAILED", "PARSE_ERROR"),
    ("a", 16, at(40), "RESOLVING", None), ("a", 17, at(41), "INDEXED", None), ("d", 18, at(42), "PENDING", None),
    ("c", 19, at(130), "EMBEDDING", None), ("d", 20, at(131), "DELETING", None), ("d", 21, at(132), "PENDING", None),
    ("f", 22, at(500), "PENDING", None), ("f", 23, at(900), "PENDING", None),
]


def plain(moves):
    states, out = {}, []
    for doc, seq, when, status, error in moves:
        rows, states[doc] = RULES.step(states.get(doc), (seq, pd.Timestamp(when), status, error))
        out += [(doc, *r) for r in rows]
    return out


def rows_of(spark, path):
    return sorted(((r.doc_id, pd.Timestamp(r.at), r.current, r.status, r.verdict, r.error_code, r.attempts) for r in spark.read.schema(VERDICTS).parquet(path).collect()), key=repr)


def arrive(spark, folder, moves):
    spark.createDataFrame(moves, MOVES).coalesce(1).write.mode("append").parquet(folder)


def test_steps():
    steps = plain(MADE)
    told = [(r[0], r[3], r[4], r[6]) for r in steps]
    assert ("b", "PENDING", "retry", 1) in told and ("b", "FAILED", "ok", 2) in told
    assert ("c", "FAILED", "expired", 0) in told and ("c", "EMBEDDING", "illegal", 0) in told
    assert ("d", "INDEXED", "illegal", 0) in told and ("d", "PENDING", "illegal", 0) in told and ("e", "PARSING", "unknown", 0) in told
    state = ("PARSING", 0, pd.Timestamp(START), 7)
    assert RULES.step(state, (7, pd.Timestamp(START), "FAILED", "X")) == ([], state), "a row delivered again"
    assert RULES.step(state, (8, pd.Timestamp(START), "FAILED", "X"))[1][0] == "FAILED"


@pytest.mark.parametrize("stops", [(), (10,)])
def test_a_restart_from_the_checkpoint_goes_on_where_it_was(spark, tmp_path, stops):
    folder, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    for a, b in zip((0, *stops), (*stops, len(MADE)), strict=True):
        arrive(spark, folder, MADE[a:b])
        query = run_moves(spark, folder, out, checkpoint, RULES)
        query.awaitTermination(120)
        assert query.exception() is None
    assert rows_of(spark, out) == sorted(plain(MADE), key=repr)
    ledger = {r.doc_id: (r.status, r.attempts) for r in ledger_of(spark.read.schema(VERDICTS).parquet(out)).collect()}
    assert ledger == {"a": ("INDEXED", 0), "b": ("FAILED", 2), "c": ("FAILED", 0), "d": ("DELETING", 0), "f": ("PENDING", 0)}


def test_a_document_that_stands_still_is_failed_by_the_watermark(spark, tmp_path):
    folder, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    moves = [("c", 1, at(0), "PENDING", None), ("c", 2, at(1), "PARSING", None)]
    arrive(spark, folder, moves)
    for n in (300, 600):  # other documents' moves take the watermark on
        arrive(spark, folder, [("z", n, at(n), "PENDING", None)])
    run_moves(spark, folder, out, checkpoint, RULES).awaitTermination(120)
    assert [r[1:5] for r in rows_of(spark, out) if r[4] == "expired"] == [(pd.Timestamp(at(61)), "PARSING", "FAILED", "expired")]
