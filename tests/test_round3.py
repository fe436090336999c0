"""What the findings of round 3 were about, on tables small enough to see."""

import math

from pyspark.sql import functions as F

from tidemill.config import Settings
from tidemill.operators import graph, jobs, search
from tidemill.plans.models import hash_embedder, hashed_vector
from tidemill.plans.retrieve import link
from tidemill.session import BATCH_BYTES
from tidemill.sources.keyed import KeyedTable
from tidemill.sources.readers import table


def test_all_queued_jobs_can_be_claimed(spark):
    new = spark.createDataFrame([("a", "t", None), ("b", "t", None), ("c", "t", None)], "job_id string, task string, payload string")
    queued = jobs.publish(jobs.publish(spark.createDataFrame([], jobs.JOBS), new.filter("job_id < 'c'"), F.current_timestamp()), new.filter("job_id = 'c'"), F.current_timestamp(), "later")
    running, mine = jobs.claim(queued, None)
    assert sorted((r.job_id, r.attempts) for r in mine.collect()) == [("a", 1), ("b", 1)]
    assert sorted((r.job_id, r.state) for r in running.collect()) == [("a", "in_progress"), ("b", "in_progress"), ("c", "queued")]


def test_a_seed_finds_the_entity_of_its_name_among_equal_vectors(spark):
    names = [f"supplier#{n:09d}" for n in range(400)]
    seen = {}
    one, two = next((seen[v], n) for n in names if (v := tuple(hashed_vector(n))) in seen or seen.setdefault(v, n) is None)
    entities = spark.createDataFrame([("E1", one), ("E2", two)], "canonical_id string, name_normalized string")
    seeds = spark.createDataFrame([("q1", one.title()), ("q2", two)], "query_id string, seed string")
    found = link(seeds, entities, hash_embedder(), Settings()).filter("rank = 1").collect()
    assert {r.query_id: r.canonical_id for r in found} == {"q1": "E1", "q2": "E2"}


def test_vectors_of_texts_with_words_have_length_one():
    for text in [*(f"longword{n}" for n in range(500)), "\n", "\t　"]:
        assert math.isclose(math.hypot(*hashed_vector(text)), 1), text
    assert not any(hashed_vector("  ")) and not any(hashed_vector(""))


def test_texts_are_dealt_to_partitions_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(search, "TEXT_BYTES", 100)
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), F.lit("one two two and more").alias("text"))
    terms = search.term_frequencies(chunks)
    assert terms.rdd.getNumPartitions() == 10
    assert {(r.term, r.tf) for r in terms.filter("chunk_id = 7").collect()} == {("one", 1.0), ("two", 2.0), ("and", 1.0), ("more", 1.0)}


def test_edges_of_a_type_are_ranked_once_for_all_questions(spark):
    edges = spark.range(200).select(F.lit("S").alias("src_id"), F.col("id").cast("string").alias("dst_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("type"), (F.col("id") / 200).alias("confidence"), F.lit("c").alias("chunk_id"), F.lit("d").alias("doc_id"))
    asked = spark.createDataFrame([(str(n), "AB"[n % 2]) for n in range(30)] + [("30", "A"), ("30", "B")], "query_id string, relation_type string")
    found = graph.entities_by_relation(asked, edges, 3)
    got = {}
    for r in found.orderBy("query_id", "path_rank").collect():
        got.setdefault(r.query_id, []).append(int(r.nodes[1]))
    assert got == {str(n): [[198, 196, 194], [199, 197, 195]][n % 2] for n in range(30)} | {"30": [199, 198, 197]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(type" in plan


def test_one_delta_needs_no_window(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k string, v int", ["k"], compact_at=100)
    table.insert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), ["v"])
    read = table.read()
    assert "Window" not in read._jdf.queryExecution().optimizedPlan().toString()
    table.delete(spark.createDataFrame([("a",)], "k string"))
    assert [tuple(r) for r in table.read().collect()] == [("b", 2)]


def test_tables_bound_the_batches_of_python(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    table(spark, "/root/testdata/sf0.001", "documents")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
