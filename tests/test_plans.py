import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemill.config import Chunking, Orchestration, Settings
from tidemill.errors import LLMProviderExhausted, RetrievalBackendUnavailable, ValidationError
from tidemill.operators.search import inverse_frequencies
from tidemill.plans import ingest as P
from tidemill.plans import orchestrate as O
from tidemill.plans.evaluate import as_results
from tidemill.plans.extract import extract
from tidemill.plans.models import hash_embedder, structured
from tidemill.plans.retrieve import fused, graph_leg, retriever, vector_leg
from tidemill.sources import files
from tidemill.sources.readers import Snapshots
from tidemill.streaming.jobs import event_windows, ingest_stream, read_corpus, sessions

SETTINGS = Settings(chunking=Chunking(120, 20, 10))
NOW = F.lit
SHARED = "This paragraph is the same in every document that holds it, word for word."


def documents(spark, *texts):
    rows = [(f"d{i}", f"u{i}", t, "text/plain", f"sha-{t}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, uri string, text string, mime_type string, sha256 string")


def sources(corpus):
    return {(r.chunk_id, r.doc_id) for r in corpus.registry.collect()}


def test_ingest_shares_chunks_and_deletes(spark):
    docs = documents(spark, SHARED, SHARED + "\r", "Something else.")
    corpus = P.ingest(P.empty_corpus(spark), docs, hash_embedder(), SETTINGS)
    assert corpus.chunks.count() == 2 and len(sources(corpus)) == 3 and corpus.version == 1
    again = P.ingest(corpus, docs, hash_embedder(), SETTINGS)
    assert sources(again) == sources(corpus) and again.chunks.count() == 2
    one = P.delete(corpus, "d0")
    assert one.chunks.count() == 2 and len(sources(one)) == 2
    two = P.delete(one, "d1")
    assert two.chunks.count() == 1 and {r.doc_id: r.status for r in two.ledger.collect()} == {"d0": "DELETING", "d1": "DELETING", "d2": "INDEXED"}
    kept, lost = P.reindex(corpus)
    assert sorted(len(r.doc_ids) for r in kept.collect()) == [1, 2] and lost.count() == 0
    # what was deleted is still known
    assert P.ingest(two, docs, hash_embedder(), SETTINGS).chunks.count() == 1


def reader(role, request):
    assert role == "bulk"
    mentions, relations = [], []
    for c in request["chunks"]:
        n = len(c["text"])
        mentions += [{"chunk_id": c["chunk_id"], "surface": "Acme", "type": "ORG", "char_start": 0, "char_end": e, "confidence": 0.9} for e in (min(4, n), 5000)]
        relations.append({"chunk_id": c["chunk_id"], "src_surface": "Acme", "dst_surface": "Beta", "type": "R", "confidence": 0.5, "evidence_span": "x"})
    mentions.append({"chunk_id": "unknown", "surface": "x", "type": "ORG", "char_start": 0, "char_end": 1, "confidence": 1.0})
    return {"value": {"mentions": mentions, "relations": relations + [{"chunk_id": "unknown", "src_surface": "a", "dst_surface": "b", "type": "R", "confidence": 1.0, "evidence_span": ""}]}}


def broken(role, request):
    return {"value": None, "prompt_tokens": 5}


def test_extraction_is_checked(spark):
    chunks = spark.createDataFrame([("d", f"c{i}", i, "short") for i in range(45)], "doc_id string, chunk_id string, ord int, text string")
    mentions, relations, errors = extract(chunks, reader)
    assert mentions.count() == 45 and relations.count() == 45 and errors.count() == 0
    assert extract(chunks, broken)[2].groupBy("error").count().collect()[0].asDict() == {"error": "LLM_SCHEMA_VIOLATION", "count": 45}


def test_structured_counts_all_attempts():
    calls = []

    def second(role, request):
        calls.append(request)
        return {"value": len(calls) if len(calls) > 1 else None, "prompt_tokens": 10, "completion_tokens": 1, "latency_ms": 2}

    assert structured(second, "r", {}, lambda v: v is not None) == {"value": 2, "prompt_tokens": 20, "completion_tokens": 2, "latency_ms": 4, "repair_attempts": 1}


class Script:
    """A model that answers by role from a table."""

    def __init__(self, **answers):
        self.answers = {"router": {"strategy": "hybrid", "query": "better"}, "grader": True, "synth": ["c1"], "judge": 0.9} | answers

    def __call__(self, role, request):
        a = self.answers[role]
        if isinstance(a, Exception):
            raise a
        if role == "grader":
            a = {"grades": [{"chunk_id": c["chunk_id"], "relevant": a} for c in request["chunks"]][: None if a is not None else 1]}
        elif role == "synth":
            a = {"text": "answer", "citations": [{"chunk_id": c} for c in a], "confidence": 0.8}
        elif role == "judge":
            a = {"score": a}
        return {"value": a, "prompt_tokens": 10, "completion_tokens": 5, "latency_ms": 7}


def found(n=3):
    chunks = json.dumps([{"chunk_id": f"c{i}", "doc_id": "d", "uri": "u", "text": "t"} for i in range(n)])
    return lambda asked: asked.select("query_id", F.lit(chunks).alias("fused"), F.array().cast("array<string>").alias("degraded"))


def ask(spark, model, retrieve=None, settings=None, question="what?"):
    q = spark.createDataFrame([("q", question)], "query_id string, question string")
    final = O.answer(q, model, retrieve or found(), settings)
    row = O.results(final).collect()
    assert len(row) == 1
    return row[0], json.loads(final.collect()[0].state)


def test_a_plain_answer(spark):
    row, state = ask(spark, Script())
    assert (row.answer, row.citations, row.strategy, row.refused, row.status) == ("answer", ["c1"], "hybrid", False, "end")
    assert tuple(row.spent) == (4, 60, 7) and state["attempts"]["generate"] == 1


def test_rewrites_are_bounded(spark):
    row, state = ask(spark, Script(grader=False))
    assert row.refused and row.answer == O.REFUSAL and state["attempts"]["rewrite_query"] == 2 and state["refusal_reason"] == "irrelevant_context"
    assert state["active_query"] == "better" and state["question"] == "what?"
    assert ask(spark, Script(), found(0))[1]["refusal_reason"] == "no_retrieval"


def test_repairs_are_bounded(spark):
    for broken_part in ({"synth": ["nowhere"]}, {"judge": 0.1}):
        row, state = ask(spark, Script(**broken_part))
        assert row.refused and state["attempts"]["repair"] == 2 and len(row.citations) == 3
    assert state["failures"][0]["code"] == "UNGROUNDED_ANSWER"


def test_failing_parts_fail_open(spark):
    row, state = ask(spark, Script(grader=LLMProviderExhausted("gone")))
    assert row.answer == "answer" and row.degraded == ["grader"] and len(state["graded"]) == 3
    row, state = ask(spark, Script(grader=None))
    assert len(state["graded"]) == 3 and state["failures"][0]["code"] == "GRADES_INCOMPLETE"
    row, state = ask(spark, Script(router={"strategy": "odd", "query": "q"}))
    assert row.strategy == "hybrid" and state["failures"][0]["code"] == "LLM_SCHEMA_VIOLATION"


def test_guard_and_budget(spark):
    assert ask(spark, Script(), question="  ")[0].error == "VALIDATION_ERROR"
    assert ask(spark, Script(), question="x" * 2001)[0].error == "VALIDATION_ERROR"
    tight = Settings(limits=Settings().limits.__class__(max_llm_calls=2))
    row, state = ask(spark, Script(), settings=tight)
    assert row.refused and state["refusal_reason"] == "budget"
    off = Settings(orchestration=Orchestration(check_groundedness=False))
    assert tuple(ask(spark, Script(), settings=off)[0].spent)[0] == 3


def test_many_rows_and_override(spark):
    q = spark.createDataFrame([(str(i), "q?", s) for i, s in enumerate(["vector", None, "graph"] * 5)], "query_id string, question string, strategy string")
    rows = O.results(O.answer(q, Script(), found())).collect()
    assert sorted(r.strategy for r in rows) == ["graph"] * 5 + ["hybrid"] * 5 + ["vector"] * 5
    assert {r.said_no for r in as_results(spark.createDataFrame(rows, O.results(O.answer(q, Script(), found())).schema)).collect()} == {False}


def test_both_legs(spark):
    corpus = P.ingest(P.empty_corpus(spark), documents(spark, "The turbine hall holds a rotor.", "Cats sleep all day long.", "Rotor blades of the turbine."), hash_embedder(), SETTINGS)
    idf = inverse_frequencies(corpus.terms, corpus.chunks)
    queries = spark.createDataFrame([("1", "turbine rotor"), ("2", "  ")], "query_id string, query string")
    hits = vector_leg(queries, corpus, idf, hash_embedder(), SETTINGS)
    text = {r.chunk_id: r.text for r in corpus.chunks.collect()}
    best = {(r.query_id, r["rank"]): text[r.chunk_id] for r in hits.collect()}
    assert "turbine" in best["1", 1] and "turbine" in best["1", 2] and not any(q == "2" for q, _ in best)
    entities = spark.createDataFrame([("A", "acme works"), ("B", "beta labs")], "canonical_id string, name_normalized string")
    relates = spark.createDataFrame([("A", "B", "R", 0.9, "k", "d")], "src_id string, dst_id string, type string, confidence double, chunk_id string, doc_id string")
    mentions = spark.createDataFrame([("k", "A", 0.9, 0), ("k", "B", 0.9, 3)], "chunk_id string, entity_id string, confidence double, char_start int")
    plans = spark.createDataFrame(
        [("n", "neighbors", ["acme works"], 1, None), ("p", "path_between", ["acme works", "beta labs"], 2, None), ("f", "path_between", ["acme works", "zzz"], 2, None), ("r", "entities_by_relation", [], 1, "R"), ("c", "co_mentioned", ["beta labs"], 1, None), ("x", "neighbors", ["zzz"], 1, None), ("t", "top_entities_for_chunks", ["acme works"], 1, None)],
        "query_id string, template string, seed_entities array<string>, hops int, relation_type string",
    )
    got = {r.query_id: r.nodes for r in graph_leg(plans, entities, relates, mentions, hash_embedder(), SETTINGS).collect()}
    assert got == {"n": ["A", "B"], "p": ["A", "B"], "f": ["A", "B"], "r": ["A", "B"], "c": ["A"], "t": ["A", "B"]}
    both = fused(hits, graph_leg(plans.filter("query_id = 'n'"), entities, relates, mentions, hash_embedder(), SETTINGS), SETTINGS)
    assert {r.query_id for r in both.collect()} == {"1", "n"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.md").write_text("# title")
    (tmp_path / "empty.txt").write_text(" \n ")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\x00\x80")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
        z.writestr("docProps/core.xml", '<cp:coreProperties xmlns:cp="x" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Name</dc:title></cp:coreProperties>')
    found_files = files.collect(spark, str(tmp_path))
    ok, refused = files.admitted(found_files)
    assert [r.reason for r in refused.collect()] == ["UNSUPPORTED_TYPE"]
    parsed, errors = files.parse(ok)
    assert {(r.text, r.title, r.mime_type) for r in parsed.collect()} == {("plain text", None, files.PLAIN), ("# title", None, files.MARKDOWN), ("One\n\nTwo", "Name", files.DOCX)}
    assert [r.error for r in errors.collect()] == ["EMPTY_TEXT"]
    with pytest.raises(ValidationError):
        files.collect(spark, "ftp://x/y")
    assert files.joined_pages(["ab", "c"]) == ("ab\n\nc", [{"start": 0, "end": 2}, {"start": 4, "end": 5}])
    assert files.persist_upload(b"x", "id", str(tmp_path / "up")).startswith("file://")


def test_stream_equals_batch_and_replays(spark, tmp_path):
    docs = documents(spark, SHARED, SHARED + "\r", "Something else.")
    arrivals = str(tmp_path / "in")
    docs.coalesce(1).write.mode("append").json(arrivals)
    store = Snapshots(spark, str(tmp_path / "lake"))
    for checkpoint in ("one", "two"):  # the second has no memory, as after a loss
        ingest_stream(spark, arrivals, store, str(tmp_path / checkpoint), hash_embedder(), SETTINGS).awaitTermination()
        streamed = read_corpus(store)
        assert sources(streamed) == sources(P.ingest(P.empty_corpus(spark), docs, hash_embedder(), SETTINGS))
        assert streamed.chunks.count() == 2 and streamed.ledger.count() == 3
    assert store.versions("ledger") == [1, 2]


def test_a_batch_lost_before_its_ledger_is_written_again(spark, tmp_path):
    docs = documents(spark, SHARED, "Something else.")
    store = Snapshots(spark, str(tmp_path / "lake"))
    new = P.added(read_corpus(store), docs, hash_embedder(), SETTINGS)
    store.add("chunks", new.chunks, new.version)  # lost here
    assert read_corpus(store).chunks.count() == 0
    arrivals = str(tmp_path / "in")
    for n, part in enumerate((docs, documents(spark, SHARED, "Something else.", "A third one."))):
        part.coalesce(1).write.mode("append").json(arrivals)
        ingest_stream(spark, arrivals, store, str(tmp_path / "checkpoint"), hash_embedder(), SETTINGS).awaitTermination()
        after = read_corpus(store)
        assert after.chunks.count() == after.chunks.select("chunk_id").distinct().count() == 2 + n
    # each batch wrote its own rows only
    assert spark.read.parquet(f"{tmp_path}/lake/chunks/v2").count() == 1
    store.expire("ledger", 1)
    assert store.versions("ledger") == [2] and read_corpus(store).chunks.count() == 3


def test_documents_walk_the_ledger(spark):
    from tidemill.operators import ledger as L

    assert L.route("PENDING", "INDEXED") == ("PARSING", "EMBEDDING", "EXTRACTING", "RESOLVING", "INDEXED")
    assert L.route("EXTRACTING", "INDEXED") == ("RESOLVING", "INDEXED") and L.route("INDEXED", "INDEXED") == ()
    assert L.route("FAILED", "PARSING") == ("PENDING", "PARSING") and L.route("DELETING", "INDEXED") is None
    for s in L.STATUSES:
        for t in L.STATUSES:
            steps = L.route(s, t)
            assert steps is None or all(L.legal(a, b) for a, b in zip((s, *steps), steps, strict=False))
    # a document without chunks is done too
    corpus = P.ingest(P.empty_corpus(spark), documents(spark, SHARED, " \x01 "), hash_embedder(), SETTINGS)
    assert {(r.status, r.corpus_version) for r in corpus.ledger.collect()} == {("INDEXED", 1)}
    gone = P.delete(corpus, "d0" if corpus.ledger.filter("doc_id = 'd0'").count() else corpus.ledger.first().doc_id)
    dead = gone.ledger.filter("status = 'DELETING'")
    with pytest.raises(Exception, match="illegal or unknown"):
        L.advance(gone.ledger, dead, "INDEXED", F.current_timestamp(), 2).collect()
    with pytest.raises(Exception, match="illegal or unknown"):
        L.advance(gone.ledger, spark.createDataFrame([("nobody",)], "doc_id string"), "INDEXED", F.current_timestamp(), 2).collect()


def test_event_windows_as_a_stream(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp_seconds(id * 600) as ts, id % 3 as user_id, 'click' as event_type, 1.0D as value from range(20)")
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    query = event_windows(stream, late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.start, r.n) for r in spark.table("w").collect()} == {(r.start, r.n) for r in event_windows(rows).collect()}
    assert event_windows(rows, "1 hour", "30 minutes").count() > event_windows(rows).count()
    assert sessions(rows, "25 minutes").agg(F.sum("n")).first()[0] == 20


def test_a_leg_whose_store_is_away_is_marked_and_the_other_goes_on(spark, tmp_path):
    corpus = P.ingest(P.empty_corpus(spark), documents(spark, "The turbine hall holds a rotor.", "Rotor blades of the turbine."), hash_embedder(), SETTINGS)
    idf = inverse_frequencies(corpus.terms, corpus.chunks)
    chunk = corpus.chunks.orderBy("chunk_id").first().chunk_id
    edge = "src_id string, dst_id string, type string, confidence double, chunk_id string, doc_id string"
    spark.createDataFrame([("A", "B", "R", 0.9, chunk, "d")], edge).write.parquet(f"file://{tmp_path}/relates")
    entities = spark.createDataFrame([("A", "acme works")], "canonical_id string, name_normalized string")
    mentions = spark.createDataFrame([(chunk, "A", 0.9, 0)], "chunk_id string, entity_id string, confidence double, char_start int")
    there = lambda: (entities, spark.read.schema(edge).parquet(f"file://{tmp_path}/relates"), mentions)
    away = lambda: (entities, spark.read.parquet(f"file://{tmp_path}/nowhere"), mentions)

    def down():
        raise RetrievalBackendUnavailable("no store of vectors")

    plan = '{{"strategy": "{}", "template": "entities_by_relation", "seed_entities": [], "hops": 1, "relation_type": "R"}}'
    asked = spark.createDataFrame([(s, "turbine rotor", plan.format(s)) for s in ("vector", "graph", "hybrid")], "query_id string, active_query string, plan string")

    def found(vectors, graphs):
        rows = retriever(vectors, graphs, hash_embedder(), SETTINGS)(asked).collect()
        return {r.query_id: ([c["chunk_id"] for c in json.loads(r.fused)] if r.fused else [], r.degraded) for r in rows}

    both = found(lambda: (corpus, idf), there)
    assert [len(both[s][0]) for s in ("vector", "graph", "hybrid")] == [2, 1, 2] and both["graph"][0] == [chunk] == both["hybrid"][0][:1]
    assert all(marks == [] for _, marks in both.values())
    no_graph = found(lambda: (corpus, idf), away)
    assert {s: m for s, (_, m) in no_graph.items()} == {"vector": [], "graph": ["graph"], "hybrid": ["graph"]}
    assert no_graph["graph"][0] == [] and len(no_graph["hybrid"][0]) == 2
    no_vectors = found(down, there)
    assert {s: m for s, (_, m) in no_vectors.items()} == {"vector": ["vector"], "graph": [], "hybrid": ["vector"]}
    with pytest.raises(AnalysisException):  # a fault of the plan is no store that is away
        found(lambda: (corpus, idf), lambda: (entities, mentions, mentions))
