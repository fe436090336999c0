"""Search by blocks of postings against the sum over all of them."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemill.operators import postings
from tidemill.operators.fusion import ranked
from tidemill.operators.search import inverse_frequencies

#: Frequent words of low weight and rare ones of high weight, as in texts.
WORDS = [f"w{n}" for n in range(60)]


def corpus(spark, n=3000, seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for w in set(rng.choices(WORDS, weights=[1 / (1 + r) for r in range(60)], k=12)):
            rows.append((c, w, float(rng.randint(1, 6))))
    df = {w: sum(r[1] == w for r in rows) for w in WORDS}
    weights = {w: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for w, d in df.items()}
    queries = [(q, w, weights[w] * rng.randint(1, 2)) for q in range(40) for w in set(rng.choices(WORDS, k=rng.randint(1, 9)))]
    return spark.createDataFrame(rows, "chunk_id long, term string, tf double").repartition(6), spark.createDataFrame([*queries, (99, "unknown", 1.0)], "query_id long, term string, weight double")


def full(queries, terms, k):
    scored = terms.join(queries, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("tf")), 9).alias("score"))
    return ranked(scored, [F.desc("score"), "chunk_id"], top=k)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 7)) for r in df.collect())


def test_same_rows_as_the_full_sum(spark, monkeypatch):
    terms, queries = corpus(spark)
    index = postings.build(terms)
    for k in (1, 10, 5000):
        assert rows_of(postings.top_k(queries, index, k)) == rows_of(full(queries, terms, k))
    monkeypatch.setattr(postings, "QUERY_TERMS", 10)  # several shards, several waves of queries
    monkeypatch.setattr(postings, "WAVE", 3)
    index = postings.build(terms, most=4000)
    assert index.count() > 4
    assert rows_of(postings.top_k(queries, index, 10)) == rows_of(full(queries, terms, 10))
    some = spark.range(0, 3000, 3).withColumnRenamed("id", "chunk_id")
    assert rows_of(postings.top_k(queries, index, 10, allowed=some)) == rows_of(full(queries, terms.join(some, "chunk_id"), 10))
    weights = {r.term: (r.df, round(r.idf, 9)) for r in postings.inverse_frequencies(index, spark.range(3000)).collect()}
    assert weights == {r.term: (r.df, round(r.idf, 9)) for r in inverse_frequencies(terms, spark.range(3000)).collect()}


def test_most_postings_are_skipped(spark):
    """Chunks of very different lengths, as texts are."""
    terms, queries = corpus(spark, n=20_000)
    terms = terms.withColumn("tf", F.col("tf") * F.ceil(1000 / (1 + F.col("chunk_id") % 997)))
    assert rows_of(postings.top_k(queries, postings.build(terms), 10)) == rows_of(full(queries, terms, 10))
    work = postings.top_k(queries, postings.build(terms), 10, counted=True).agg(F.sum("postings").alias("all"), F.sum("read").alias("read")).first()
    assert 0 < work["read"] < 0.3 * work["all"]


def test_equal_texts_tie_by_key_and_empty_tables(spark):
    terms = spark.createDataFrame([(f"c{n:03d}", w, 1.0) for n in range(300) for w in ("a", "b")], "chunk_id string, term string, tf double")
    queries = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.2)], "query_id string, term string, weight double")
    got = postings.top_k(queries, postings.build(terms), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [f"c{n:03d}" for n in range(5)]
    assert postings.top_k(queries, postings.build(terms.limit(0)), 5).count() == 0
    assert postings.top_k(queries.limit(0), postings.build(terms), 5).count() == 0
