import pytest
from pyspark.sql import functions as F

from tidemill.errors import ConflictError
from tidemill.operators import graph, provenance, tables
from tidemill.operators import ledger as L
from tidemill.schemas import CHUNK_SOURCES, LEDGER, STATUSES, assert_columns, check_sparse, check_width

NOW = "timestamp_seconds(0)"


def registry(spark, rows):
    return spark.createDataFrame([(c, d, f"u:{d}", None, 0, 9, None) for c, d in rows], CHUNK_SOURCES)


def test_insert_if_absent_is_idempotent(spark):
    base = registry(spark, [])
    rows = registry(spark, [("c", f"d{i}") for i in range(16)] + [("c", "d0")])
    once = provenance.register_sources(base, rows)
    assert once.count() == 16 and provenance.register_sources(once, rows).count() == 16


def test_projection_repairs_and_finds_orphans(spark):
    reg = registry(spark, [("c", "a"), ("c", "b")])
    chunks = spark.createDataFrame([("c", "text", []), ("gone", "t", ["x"])], "chunk_id string, text string, sources array<string>")
    for _ in range(2):
        fixed, lost = provenance.project(chunks, reg, chunks)
        row = fixed.collect()
        assert [(r.chunk_id, r.doc_ids) for r in row] == [("c", ["a", "b"])]
        assert [r.chunk_id for r in lost.collect()] == ["gone"]


def test_shared_chunk_survives_one_owner(spark):
    reg = registry(spark, [("c", "a"), ("c", "b"), ("only", "a")])
    left, touched = provenance.remove_document(reg, "a")
    assert {r.chunk_id for r in provenance.orphans(touched, left).collect()} == {"only"}
    left, touched = provenance.remove_document(left, "b")
    assert {r.chunk_id for r in provenance.orphans(touched, left).collect()} == {"c"}
    assert [(r.doc_id, r.chunk_id) for r in provenance.only_owned(reg, reg).collect()] == [("a", "only")]


def test_merge_keeps_creation(spark):
    old = spark.createDataFrame([("e1", "old", "then"), ("e2", "stays", "then")], "canonical_id string, name string, created_at string")
    new = spark.createDataFrame([("e1", "new"), ("e3", "made")], "canonical_id string, name string")
    got = {tuple(r) for r in graph.upsert_entities(old, new, F.lit("now")).collect()}
    assert got == {("e1", "new", "then"), ("e2", "stays", "then"), ("e3", "made", "now")}


def test_provenance_is_required(spark):
    rows = spark.createDataFrame([("s", "d", "t", 0.5, None, "doc", None)], "src_id string, dst_id string, type string, confidence double, chunk_id string, doc_id string, evidence_span string")
    with pytest.raises(Exception, match="relations need"):
        graph.upsert_relations(rows.limit(0), rows).collect()


def test_all_status_moves(spark):
    ledger = spark.createDataFrame([(s, "u", s, "m", s, None, 0, 0, None, None) for s in STATUSES], LEDGER)
    changes = spark.createDataFrame([(a, b, None) for a in STATUSES for b in STATUSES], "doc_id string, status string, error_code string")
    verdicts = {(r.current, r.status): r.verdict for r in L.judged(ledger, changes).collect()}
    assert len(verdicts) == 64
    assert all((v == "ok") == L.legal(a, b) for (a, b), v in verdicts.items())
    assert verdicts["INDEXED", "PENDING"] == verdicts["DELETING", "FAILED"] == "illegal" and verdicts["FAILED", "PENDING"] == verdicts["FAILED", "FAILED"] == "ok"
    done = L.set_status(ledger, spark.createDataFrame([("PENDING", "FAILED", "E")], "doc_id string, status string, error_code string"), F.expr(NOW))
    assert {(r.doc_id, r.status, r.error_code) for r in done.collect() if r.doc_id == "PENDING"} == {("PENDING", "FAILED", "E")} and done.count() == 8
    for bad in (("INDEXED", "PENDING", None), ("nobody", "PENDING", None)):
        with pytest.raises(Exception, match="transition"):
            L.set_status(ledger, spark.createDataFrame([bad], "doc_id string, status string, error_code string"), F.expr(NOW)).collect()


def test_register_purge_and_version(spark):
    empty = spark.createDataFrame([], LEDGER)
    up = spark.createDataFrame([("1", "u1", "s", "m"), ("2", "u2", "s", "m"), ("3", "u3", "t", "m")], "doc_id string, uri string, sha256 string, mime_type string")
    ledger, marked = L.register(empty, up, F.expr(NOW))
    assert {r.doc_id: r.inserted for r in marked.collect()} == {"1": True, "2": False, "3": True}
    again, marked = L.register(ledger, up, F.expr(NOW))
    assert again.count() == 2 and not any(r.inserted for r in marked.collect())
    left, known = L.purge(ledger, spark.createDataFrame([("1",), ("9",)], "doc_id string"))
    assert left.count() == 1 and {r.doc_id: r.existed for r in known.collect()} == {"1": True, "9": False}
    assert L.purge_for_force(ledger, up).count() == 0
    v = L.CorpusVersion()
    assert (v.current(), v.bump(), v.bump(), v.current()) == (0, 1, 2, 2)


def test_delete_document_cascades(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    held = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "doc_id string, chunk_id string")
    chunks = spark.createDataFrame([("x",), ("y",)], "chunk_id string")
    for cascade, left in ((False, 2), (True, 1)):
        out = graph.delete_document(docs, held, chunks, chunks, chunks, docs.filter("doc_id = 'a'"), cascade)
        assert [out[k].count() for k in ("documents", "has_chunk", "chunks", "mentions", "relates")] == [1, 1, 1, 1, left]


def test_shapes_and_checks(spark):
    df = spark.createDataFrame([([1, 2], [0.5, 0.5])], "i array<int>, v array<double>")
    assert check_sparse(df, "i", "v").count() == 1 and check_width(df, "v", 2).count() == 1
    with pytest.raises(Exception, match="sparse"):
        check_sparse(spark.createDataFrame([([2, 1], [0.5, 0.5])], df.schema), "i", "v").collect()
    with pytest.raises(Exception, match="components"):
        check_width(df, "v", 3).collect()
    assert assert_columns(df, "i array<int>", "t") is df
    with pytest.raises(ConflictError):
        assert_columns(df, "i array<string>", "t")


def test_filters_lookup_and_cache(spark):
    df = spark.createDataFrame([("a", ["x", "y"], 1), ("b", ["z"], 2)], "chunk_id string, doc_ids array<string>, n int")
    keep = lambda c: [r.chunk_id for r in tables.payload_filter(df, c).collect()]
    assert keep({"doc_ids": ["y", "q"]}) == ["a"] and keep({"doc_ids": "z", "n": 2}) == ["b"] and keep({"doc_ids": "z", "n": 1}) == [] and keep({}) == ["a", "b"]
    ids = spark.createDataFrame([("a",), ("a",), ("q",)], "chunk_id string")
    assert tables.lookup(df, ids, "chunk_id").count() == 1
    answers, fresh = tables.read_through(ids, spark.createDataFrame([("a", 7)], "chunk_id string, v int"), "chunk_id", lambda m: m.withColumn("v", F.lit(9)))
    assert sorted(r.v for r in answers.collect()) == [7, 7, 9] and fresh.count() == 1
