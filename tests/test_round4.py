"""What the findings F3, F7 and F16 of round 3 were about, on tables small enough to see."""

import datetime
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from tidemill.config import Chunking, Settings
from tidemill.operators import search
from tidemill.plans import ingest as P
from tidemill.plans.models import hash_embedder
from tidemill.queries import QUERIES
from tidemill.streaming.lifecycle import MOVES, TIMEOUT, VERDICTS, Lifecycle, run_moves

SETTINGS = Settings(chunking=Chunking(120, 20, 10))


def test_a_text_that_ends_with_a_repeated_chunk_reaches_its_end(spark, tmp_path):
    again = "One sentence of eight words again and again. " * 200
    texts = [(1, again.strip()), (2, "short"), (3, "\x01\x02"), (4, ""), (5, None), (6, "short"), (7, " ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r["first"], r["last"], r.status) for r in QUERIES["P1_ingest"](spark, str(tmp_path)).collect())
    assert found == sorted([(0, len(again.strip()), "INDEXED"), (0, 5, "INDEXED"), (0, 0, "INDEXED"), (0, 1, "INDEXED")])


def test_repeats_are_kept_beside_the_registry_and_go_with_their_document(spark):
    rows = [(d, f"u{d}", t, "text/plain", f"sha-{d}") for d, t in (("a", "The same few words once more. " * 40), ("b", "Something else. " + "The same few words once more. " * 40))]
    docs = spark.createDataFrame(rows, "doc_id string, uri string, text string, mime_type string, sha256 string")
    corpus = P.ingest(P.empty_corpus(spark), docs, hash_embedder(), SETTINGS)
    assert corpus.registry.count() == corpus.registry.select("chunk_id", "doc_id").distinct().count()
    places = corpus.registry.select("doc_id", "char_start", "char_end").unionByName(corpus.repeats.select("doc_id", "char_start", "char_end"))
    assert places.count() == places.distinct().count() and corpus.repeats.count() > 10
    assert {r.doc_id: r.n for r in places.groupBy("doc_id").agg(F.max("char_end").alias("n")).collect()} == {d: len(t) for d, _, t, *_ in rows}
    assert {r.doc_id for r in P.delete(corpus, "a").repeats.collect()} == {"b"}
    assert P.ingest(corpus, docs, hash_embedder(), SETTINGS).repeats.count() == corpus.repeats.count()


def test_documents_of_a_bucket_live_and_expire_apart(spark, tmp_path):
    """States are read and written by bucket, so calls are as many as buckets; the verdicts are those of each document alone."""
    rules, start = Lifecycle(timeout_s=3600, max_attempts=2), datetime.datetime(2026, 1, 1)
    at = lambda minutes: start + datetime.timedelta(minutes=minutes)
    moves = [(f"d{n}", n * 10 + k, at(n + k), s, None) for n in range(20) for k, s in enumerate(("PENDING", "PARSING", "EMBEDDING")[: 1 + n % 3])]
    later = [(f"d{n}", n * 10 + 5, at(75), "EXTRACTING", None) for n in range(20) if n % 3 == 2] + [("z", 1, at(500), "PENDING", None)]
    folder, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    for part in (moves, later, [("z", 2, at(900), "PENDING", None)]):
        spark.createDataFrame(part, MOVES).coalesce(1).write.mode("append").parquet(folder)
        query = run_moves(spark, folder, out, checkpoint, rules, buckets=1)
        query.awaitTermination(120)
        assert query.exception() is None
    states, wanted = {}, []
    for doc, seq, when, status, error in [*moves, *later, ("z", 2, at(900), "PENDING", None)]:
        made, states[doc] = rules.step(states.get(doc), (seq, pd.Timestamp(when), status, error))
        wanted += [(doc, *r) for r in made]
    wanted += [(doc, due, s[0], "FAILED", "expired", TIMEOUT, s[1]) for doc, s in states.items() if (due := rules.deadline(s)) is not None]
    found = [(r.doc_id, pd.Timestamp(r.at), r.current, r.status, r.verdict, r.error_code, r.attempts) for r in spark.read.schema(VERDICTS).parquet(out).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr) and sum(r[4] == "expired" for r in found) > 10


def test_a_task_of_dense_search_holds_few_pairs_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    queries, points = rng.normal(size=(300, 16)), rng.normal(size=(8000, 16))
    points[5:2005] = points[4]  # ties at the edge of the list
    points[7000] = 0
    lists = lambda m, name: pa.StructArray.from_arrays([pa.array(np.arange(len(m))), pa.array(list(m), pa.list_(pa.float64()))], names=["query_id", name])
    row = pa.RecordBatch.from_arrays([pa.array([0]), pa.ListArray.from_arrays([0, 300], lists(queries, "vector")), pa.ListArray.from_arrays([0, 8000], pa.array(np.arange(8000))), pa.ListArray.from_arrays([0, 8000], pa.array(list(points), pa.list_(pa.float64())))], names=["block", "queries", "keys", "vectors"])
    run = search._block_top_k(10, pa.int64(), pa.int64())
    first = pa.Table.from_batches(run(iter([row, row])))
    tracemalloc.start()
    pa.Table.from_batches(run(iter([row])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20, peak
    monkeypatch.setattr(search, "PAIRS", 8000)
    assert pa.Table.from_batches(run(iter([row, row]))).equals(first)
    length = np.sqrt((points * points).sum(axis=1))
    own = np.sqrt((queries[7] * queries[7]).sum())
    score = np.divide((queries[7] * points).sum(axis=1), own * length, out=np.zeros(len(points)), where=length > 0)
    mine = first.filter(pa.compute.equal(first["query_id"], 7))
    assert mine["key"].to_pylist()[::2] == np.lexsort((np.arange(8000), -score))[:5].tolist()
