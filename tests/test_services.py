import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.errors import ConflictError, JobTimeout, LLMProviderExhausted, RateLimited, RetrievalBackendUnavailable, ValidationError
from tidemill.metrics import Metrics, correlated, correlation
from tidemill.operators import caching, jobs
from tidemill.operators.evaluation import context_recall
from tidemill.plans import evaluate as EV
from tidemill.plans.gateway import Gateway, Readiness, Route, Wiring
from tidemill.plans.models import hash_embedder
from tidemill.plans.orchestrate import REFUSAL, run_node
from tidemill.plans.resolve import empty_graph, sink
from tidemill.schemas import GOLDEN, LEDGER
from tidemill.sources import pdf
from tidemill.sources.readers import Snapshots
from tidemill.streaming.events import node_events, sse

def now():
    return F.timestamp_seconds(F.lit(1_000_000))


# -- jobs and waiting -----------------------------------------------------------------------------------------------


def test_jobs_from_queue_to_end(spark):
    none = spark.createDataFrame([], jobs.JOBS)
    new = spark.createDataFrame([("a", "ingest", "1"), ("b", "ingest", "2"), ("c", "extract", None)], "job_id string, task string, payload string")
    queued = jobs.publish(none, new, now())
    for again in (new.limit(1), new.filter("job_id = 'c'"), spark.createDataFrame([("d", "x", ""), ("d", "x", "")], "job_id string, task string, payload string")):
        with pytest.raises(ConflictError):
            jobs.publish(queued, again, now())
    running, mine = jobs.claim(queued, 2)
    assert [(r.job_id, r.state, r.attempts) for r in mine.orderBy("job_id").collect()] == [("a", "in_progress", 1), ("b", "in_progress", 1)]
    done = spark.createDataFrame([("a", None), ("b", "JOB_TIMEOUT")], "job_id string, error string")
    after = jobs.finish(running, done, now(), max_attempts=2)
    state = lambda t: {r.job_id: (r.state, r.attempts, r.error) for r in jobs.status(t, spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "job_id string")).collect()}
    assert state(after) == {"a": ("complete", 1, None), "b": ("queued", 1, "JOB_TIMEOUT"), "c": ("queued", 0, None), "x": ("not_found", 0, None)}
    last = jobs.finish(jobs.claim(after, 5)[0], spark.createDataFrame([("b", "JOB_TIMEOUT")], "job_id string, error string"), now(), max_attempts=2)
    assert state(last)["b"] == ("failed", 2, "JOB_TIMEOUT") and state(last)["c"][0] == "in_progress"
    # a finished job's id is taken until it is dropped
    with pytest.raises(ConflictError):
        jobs.publish(after, new.limit(1), now())
    free = jobs.drop(after, spark.createDataFrame([("a",)], "job_id string"))
    assert jobs.publish(free, new.filter("job_id = 'a'"), now()).count() == 3


def test_waiting_for_documents(spark):
    state, waits = {"a": "PENDING", "b": "FAILED"}, []

    def ledger():
        return spark.createDataFrame(list(state.items()), "doc_id string, status string")

    def sleep(s):
        waits.append(s)
        state["a"] = "INDEXED" if len(waits) > 2 else "PARSING"

    assert jobs.await_documents(ledger, ["a", "b", "a"], sleep=sleep) == {"a": "INDEXED", "b": "FAILED"} and len(waits) == 3
    assert jobs.await_documents(ledger, []) == {}
    at = iter(range(100))
    with pytest.raises(JobTimeout) as e:
        jobs.await_documents(ledger, ["nobody"], timeout_s=3, sleep=lambda s: None, clock=lambda: next(at))
    assert e.value.details == {"doc_ids": ["nobody"]}


# -- cache ----------------------------------------------------------------------------------------------------------


def test_cache_lifetimes_and_prefixes(spark, tmp_path):
    cache = caching.StoredCache(spark, str(tmp_path))
    at = lambda s: F.timestamp_seconds(F.lit(1000 + s))
    assert cache.get(["ret:a"], at(0)) == {}
    cache.put({"ret:a": "1", "ret:b": "2"}, 10, at(0))
    cache.put({"emb:a": "3", "ret:b": "4"}, None, at(5))
    assert cache.get(["ret:a", "ret:b", "emb:a", "no"], at(9)) == {"ret:a": "1", "ret:b": "4", "emb:a": "3"}
    assert cache.get(["ret:a", "ret:b"], at(10)) == {"ret:b": "4"}
    assert cache.delete_prefix("ret:") == 2 and cache.delete_prefix("ret:") == 0
    assert cache.get(["ret:b", "emb:a"], at(11)) == {"emb:a": "3"} and cache.errors == 0


def test_a_broken_cache_is_a_miss(spark, tmp_path):
    cache = caching.StoredCache(spark, str(tmp_path))
    cache.put({"a": "1"}, None, now())
    for f in (tmp_path / "cache" / "v1").glob("*.parquet"):
        f.write_bytes(b"no parquet")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert cache.get(["a"], now()) == {} and cache.errors == 1
    cache.put({"b": "2"}, None, now())
    assert cache.delete_prefix("a") == 0 and cache.errors == 3


# -- metrics --------------------------------------------------------------------------------------------------------


def test_counters_ride_on_actions(spark):
    metrics = Metrics()
    rows = spark.createDataFrame([("vector", 3), ("graph", 4), ("vector", 5), ("odd", 6), (None, 7)], "strategy string, tokens int")
    seen = metrics.watch(metrics.watch(rows, "route_selected", by="strategy", labels=["vector", "graph"]), "llm_tokens", F.col("tokens"))
    assert seen.collect() == rows.collect()
    metrics.add("citations_invalid", 2)
    assert metrics.collect() == {"route_selected": {"vector": 2, "graph": 1, "other": 2}, "llm_tokens": {"": 25}, "citations_invalid": {"": 2}}
    with pytest.raises(KeyError):
        metrics.watch(rows, "retrieval_latency")

    @metrics.timed("retrieval_latency", "vector")
    def work(fail):
        if fail:
            raise ValueError

    work(False)
    with pytest.raises(ValueError):
        work(True)
    assert sum(metrics.buckets["retrieval_latency", "vector"]) == 2


def test_correlation_is_kept_or_made():
    seen = []

    @correlated
    def inner():
        seen.append(correlation.get())

    @correlated
    def outer():
        inner()
        inner()

    outer()
    inner()
    assert seen[0] == seen[1] != seen[2] and all(seen) and correlation.get() == ""


# -- gateway, readiness, wiring -------------------------------------------------------------------------------------


def test_gateway_turns_keys_retries_and_falls_back():
    calls = []

    def strict(key, role, request):
        calls.append(("strict", key))
        if key != "k3":
            raise RateLimited("slow down")
        return {"value": role}

    def shaky(key, role, request):
        calls.append(("shaky", key))
        raise RetrievalBackendUnavailable("gone")

    def sure(key, role, request):
        calls.append(("sure", key))
        return {"value": "sure"}

    gate = Gateway({"big": (Route("strict", strict, ("k1", "k2", "k3")),), "small": (Route("shaky", shaky), Route("sure", sure, ("s",))), "none": (Route("shaky", shaky),)}, {"synth": "big", "grader": "small", "judge": "none"})
    assert gate("synth", {}) == {"value": "synth", "provider": "strict"} and [k for _, k in calls] == ["k1", "k2", "k3"]
    calls.clear()
    assert gate("synth", {})["value"] == "synth" and [k for _, k in calls] == ["k3"]  # the key that answered last
    calls.clear()
    assert gate("grader", {})["provider"] == "sure" and [p for p, _ in calls] == ["shaky"] * 3 + ["sure"]
    with pytest.raises(LLMProviderExhausted):
        gate("judge", {})
    with pytest.raises(ZeroDivisionError):
        Gateway({"a": (Route("x", lambda k, r, q: 1 / 0), Route("sure", sure))}, {"r": "a"})("r", {})


def test_readiness_has_deadlines_and_is_kept():
    import threading

    hang, ran, at = threading.Event(), [], [0.0]
    probes = {"up": lambda: ran.append(1), "down": lambda: 1 / 0, "slow": lambda: hang.wait(20)}
    ready = Readiness(probes, deadline_s=0.2, clock=lambda: at[0])
    assert ready.check() == {"up": "ok", "down": "ZeroDivisionError", "slow": "timeout"} and not ready.ready() and len(ran) == 1
    at[0] = 6.0
    hang.set()
    assert ready.check()["slow"] == "ok" and len(ran) == 2


def test_wiring_closes_in_reverse():
    closed = []

    class Part:
        def __init__(self, name):
            self.name = name

        def close(self):
            closed.append(self.name)
            if self.name == "b":
                raise OSError("b")

    with pytest.raises(OSError), Wiring({"a": lambda w: Part("a"), "b": lambda w: (w["a"], Part("b"))[1], "c": lambda w: (w["b"], w["a"], Part("c"))[2], "d": lambda w: Part("d")}) as parts:
        assert parts["c"] is parts["c"]
    assert closed == ["c", "b", "a"]
    with pytest.raises(ValueError, match="x -> y -> x"):
        Wiring({"x": lambda w: w["y"], "y": lambda w: w["x"]})["x"]


# -- schema setup ---------------------------------------------------------------------------------------------------


def test_set_up_is_idempotent_and_checks_shapes(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert schemas.set_up(store) == list(schemas.STORED) and schemas.set_up(store) == []
    store.write("aliases", spark.createDataFrame([], "alias_id string"))
    with pytest.raises(ConflictError):
        schemas.set_up(store)
    other = Snapshots(spark, str(tmp_path / "o"))
    other.write("terms", spark.createDataFrame([("c", "t", 1.0)], schemas.STORED["terms"]))
    with pytest.raises(ConflictError, match="frequencies"):
        schemas.set_up(other)


# -- events ---------------------------------------------------------------------------------------------------------


def test_events_as_they_are_sent(spark):
    rows = [("q", 1, "guard", "{}"), ("q", 2, "end", '{"answer": {"text": "x"}}'), ("r", 1, "error", '{"error": {"code": "E"}}')]
    got = [r.event for r in node_events(spark.createDataFrame(rows, "query_id string, seq int, next string, state string")).orderBy("query_id", "seq").collect()]
    assert got == ['id: 1\nevent: node\ndata: {"node":"guard"}\n\n', 'id: 2\nevent: answer\ndata: {"text":"x"}\n\n', 'id: 1\nevent: error\ndata: {"code":"E"}\n\n']
    text = sse(spark.createDataFrame([("q", 1, "log", "a\nb\r\nc"), ("q", 2, "log", None)], "query_id string, seq int, kind string, data string")).orderBy("seq").collect()
    assert [r.event for r in text] == ["id: 1\nevent: log\ndata: a\ndata: b\ndata: c\n\n", "id: 2\nevent: log\ndata: \n\n"]


# -- resolution sink ------------------------------------------------------------------------------------------------


def test_sink_converges(spark):
    mentions = spark.createDataFrame([(f"c{i}", s, t, 0, 4, 0.5 + i / 100) for i, (s, t) in enumerate([("Acme Corp.", "ORG"), ("Acme", "ORG"), ("Acme", "ORG"), ("Paris", "LOC"), ("ACME", "ORG")])], "chunk_id string, surface string, type string, char_start int, char_end int, confidence double")
    relations = spark.createDataFrame([("c0", "d0", "Acme Corp.", "Paris", "IN", 0.9, "e"), ("c1", "d0", "Acme", "Nowhere", "IN", 0.9, "e"), ("c1", "d1", "ACME", "Paris", "IN", 0.7, "e")], "chunk_id string, doc_id string, src_surface string, dst_surface string, type string, confidence double, evidence_span string")
    graph = empty_graph(spark)
    stamp = datetime(2024, 1, 1)
    states = [("d0", "RESOLVING"), ("d1", "EXTRACTING")]
    ledger = spark.createDataFrame([(i, "u", i, "t", s, None, 0, 0, stamp, stamp) for i, s in states], LEDGER)
    graph = type(graph)(graph.entities, graph.aliases, graph.mentions, graph.relates, ledger)
    docs = ledger.select("doc_id")
    once, resolved = sink(graph, mentions, relations, hash_embedder(), now(), documents=docs)
    assert {r.name for r in once.entities.collect()} == {"Acme", "Paris"}
    assert once.mentions.count() == 5 and once.mentions.filter("entity_id is null").count() == 0
    ids = {r.name: r.canonical_id for r in once.entities.collect()}
    assert sorted((r.src_id, r.dst_id, r.chunk_id, r.doc_id) for r in once.relates.collect()) == sorted((ids["Acme"], ids["Paris"], c, d) for c, d in (("c0", "d0"), ("c1", "d1")))
    assert {r.doc_id: r.status for r in once.ledger.collect()} == {"d0": "INDEXED", "d1": "EXTRACTING"}
    assert once.aliases.count() == resolved.aliases.count() == 2
    twice, _ = sink(once, mentions, relations, hash_embedder(), now(), documents=docs)
    key = lambda t, *c: sorted(tuple(r) for r in t.select(*c).collect())
    for name, columns in (("mentions", ("chunk_id", "entity_id")), ("relates", ("src_id", "dst_id", "chunk_id")), ("aliases", ("alias_id", "canonical_id")), ("entities", ("canonical_id", "name"))):
        assert key(getattr(twice, name), *columns) == key(getattr(once, name), *columns)


# -- evaluation run -------------------------------------------------------------------------------------------------


def golden(spark, n):
    rows = [(f"i{k}", f"question {k}?", "single_hop", "vector", [f"c{k}"], "a", k == 3, k) for k in range(n)]
    return spark.createDataFrame(rows, GOLDEN + ", pos int")


def found(asked):
    chunk = lambda c: F.struct(c.alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit("u").alias("uri"), F.lit("t").alias("text"))
    chunks = F.array(chunk(F.regexp_replace("query_id", "i", "c")), chunk(F.lit("x1")), chunk(F.lit("x2")))
    return asked.select("query_id", F.to_json(chunks).alias("fused"), F.array().cast("array<string>").alias("degraded"))


class Flaky:
    """Fails for one question until a file exists, for another always."""

    def __init__(self, mark):
        self.mark = str(mark)

    def __call__(self, role, request):
        import os

        text = str(request)
        if role == "synth" and "question 1?" in text and not os.path.exists(self.mark):
            raise RateLimited("later")
        if role == "synth" and "question 2?" in text:
            raise LLMProviderExhausted("never")
        value = {"router": {"strategy": "vector", "query": "q"}, "grader": {"grades": [{"chunk_id": c["chunk_id"], "relevant": True} for c in request.get("chunks", [])]}, "synth": {"text": "it cannot be" if "question 3?" in text else "because", "citations": [{"chunk_id": c["chunk_id"]} for c in request.get("chunks", [])], "confidence": 0.9}}.get(role, {"score": 0.9})
        return {"value": value, "prompt_tokens": 1, "completion_tokens": 1, "latency_ms": 1}


def test_a_run_asks_again_judges_and_is_stored(spark, tmp_path):
    mark, waits = tmp_path / "mark", []

    def wait(s):
        waits.append(s)
        mark.write_text("x")

    def judge(items):
        return items.select("item_id", F.when(F.col("error").isNull(), 0.5).otherwise(F.lit(float("nan"))).alias("faithfulness"), F.when(F.col("item_id") == "i0", "m1").otherwise("m2").alias("model_served"))

    store = EV.EvalStore(spark, str(tmp_path / "evals"))
    assert not (tmp_path / "evals").exists()
    report = EV.evaluate(golden(spark, 5), Flaky(mark), found, judge=judge, store=store, subset=4, git_sha="abc", wait=wait)
    assert waits == list(EV.WAITS)  # the second item for good, the first once
    assert report.metrics["faithfulness"] == 0.5 and report.mixed_judges and report.models_served == ["m1", "m2"]
    assert report.metrics["recall_at_10"] == 0.75 and not report.passed
    saved = store.get_run(report.run_id)
    assert saved["git_sha"] == "abc" and saved["metrics"] == report.metrics and saved["finished_at"] >= saved["started_at"]
    rows = {r.item_id: r.result for r in store.get_results(report.run_id).collect()}
    assert sorted(rows) == ["i0", "i1", "i2", "i3"] and '"error":"LLM_PROVIDER_EXHAUSTED"' in rows["i2"] and '"answer":"because"' in rows["i1"]
    assert store.get_run("no") is None


def test_context_recall(spark):
    rows = [(["the cat sat", "x"], ["the cat sit", "dogs bark"]), ([], ["a"]), (["a"], []), (None, ["a"])]
    got = context_recall(spark.createDataFrame(rows, "retrieved_texts array<string>, gold_texts array<string>")).collect()
    assert [r.context_recall for r in got] == [0.5, 0.0, None, 0.0]


def test_one_step_alone(tmp_path):
    chunks = [{"chunk_id": "c9", "doc_id": "d", "uri": "u", "text": "t"}]
    follows, state = run_node("generate", Flaky(tmp_path / "m"), "question 9?", chunks)
    assert follows == "verify_citations" and [c["chunk_id"] for c in state["answer"]["citations"]] == ["c9"]
    follows, state = run_node("insufficient", None, "q", [])
    assert follows == "end" and state["answer"]["text"] == REFUSAL
    with pytest.raises(ValidationError):
        run_node("nothing", None, "q", [])


# -- PDF ------------------------------------------------------------------------------------------------------------


def pdf_file(pages, packed=False, title=b"(A \\(plain\\) title)"):
    """A small PDF: one content stream a page, optionally compressed and with its objects in an object stream."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Title " + title + b" >>", 4: b"<< /Type /Font /Subtype /Type1 >>", 5: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R >>"}
    cmap = b"2 beginbfchar <0001> <0041> <0002> <00e9> endbfchar 1 beginbfrange <0010> <0012> <03b1> endbfrange"
    streams = {6: cmap}
    kids = []
    for n, ops in enumerate(pages):
        page, contents = 10 + 2 * n, 11 + 2 * n
        kids.append(b"%d 0 R" % page)
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % contents
        streams[contents] = ops
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 4 0 R /F2 5 0 R >> >> >>" % (b" ".join(kids), len(kids))
    out = [b"%PDF-1.5\n"]
    if packed:
        places, bodies = [], b""
        for n, body in objects.items():
            places.append(b"%d %d" % (n, len(bodies)))
            bodies += body + b" "
        head = b" ".join(places) + b" "
        held = zlib.compress(head + bodies)
        out.append(b"90 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(objects), len(head), len(held), held))
    else:
        out += [b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items()]
    for n, data in streams.items():
        held = zlib.compress(data) if packed else data
        out.append(b"%d 0 obj\n<< /Length %d%s >>\nstream\n%s\nendstream\nendobj\n" % (n, len(held), b" /Filter /FlateDecode" if packed else b"", held))
    return b"".join(out) + b"trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF"


PAGES = [
    b"BT /F1 12 Tf 72 700 Td (Hello, \\050world\\051 caf\\351) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* (nested (paren) \\\\) ' ET",
    b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <000100020010> Tj 10 0 Td <00110012> Tj ET",
]


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(packed):
    texts, title = pdf.pages_of(pdf_file(PAGES, packed))
    assert texts == ["Hello, (world) café\nsecond line\nnested (paren) \\", "Aéαβγ"] and title == "A (plain) title"
    assert pdf.pages_of(pdf_file([], packed, b"<FEFF00E9>")) == ([], "é")


def test_pdf_files_are_parsed(spark, tmp_path):
    from tidemill.sources import files

    (tmp_path / "a.pdf").write_bytes(pdf_file(PAGES, True))
    (tmp_path / "b.pdf").write_bytes(pdf_file([b""]))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "d.pdf").write_bytes(pdf_file(PAGES).replace(b"/Root", b"/Encrypt 9 0 R /Root"))
    ok, refused = files.admitted(files.collect(spark, str(tmp_path)))
    parsed, errors = files.parse(ok)
    [row] = parsed.collect()
    assert row.title == "A (plain) title" and [row.text[p.start : p.end] for p in row.page_offsets] == pdf.pages_of(pdf_file(PAGES))[0]
    assert sorted(r.error for r in errors.collect()) == ["EMPTY_TEXT", "PARSE_ERROR: ValueError", "PARSE_ERROR: ValueError"] and refused.count() == 0


def test_similarities_of_nulls(spark):
    from tidemill.functions.similarity import jaro_winkler, token_set_ratio

    rows = spark.createDataFrame([(None, "a"), ("a", None), (None, None), ("a", "a"), ("", "")], "x string, y string")
    got = rows.select(jaro_winkler("x", "y").alias("j"), token_set_ratio("x", "y").alias("t")).collect()
    assert [(r.j, r.t) for r in got] == [(0, 0), (0, 0), (0, 0), (1, 1), (1, 0)]
