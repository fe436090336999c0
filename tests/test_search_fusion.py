from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.errors import ValidationError
from tidemill.operators import search
from tidemill.operators.fusion import chunks_of_paths, fuse


def lists(spark, *parts):
    return [spark.createDataFrame([("q", c, r) for c, r in p], "query_id string, chunk_id string, rank int") for p in parts]


def test_known_fusion(spark):
    got = fuse(lists(spark, [("A", 1), ("B", 2), ("C", 3)], [("C", 1), ("A", 2), ("D", 3)])).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["A", "C", "B", "D"]
    want = {"A": Fraction(1, 61) + Fraction(1, 62), "C": Fraction(1, 63) + Fraction(1, 61), "B": Fraction(1, 62), "D": Fraction(1, 63)}
    assert all(r.score == pytest.approx(float(want[r.chunk_id]), abs=1e-15) for r in got)


def test_ties_weights_and_empty(spark):
    a, b = lists(spark, [("Y", 1)], [("X", 1)])
    assert [r.chunk_id for r in fuse([a, b]).orderBy("rank").collect()] == ["X", "Y"]
    assert fuse([a, b], weights=[10, 0.1], top_n=1).collect()[0].chunk_id == "Y"
    assert fuse([a, b], weights=[0.1, 10], top_n=1).collect()[0].chunk_id == "X"
    assert fuse(lists(spark, [], [])).count() == 0
    with pytest.raises(ValidationError):
        fuse([a, b], weights=[1.0])
    twice = fuse(lists(spark, [("A", 1), ("A", 2)])).collect()
    assert twice[0].score == pytest.approx(1 / 61 + 1 / 62)


def corpus(spark):
    points = spark.createDataFrame([("fav", [1.0, 0.0], ["doc-a"]), ("rare", [0.0, 1.0], ["doc-b"])], "chunk_id string, dense array<float>, doc_ids array<string>")
    terms = spark.createDataFrame([("fav", "common", 1.0), ("rare", "common", 1.0), ("rare", "rare", 3.0)], "chunk_id string, term string, tf double")
    return points, terms, search.inverse_frequencies(terms, 2)


def hybrid(spark, words, **more):
    points, terms, idf = corpus(spark)
    dense = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, vector array<float>")
    q = spark.createDataFrame([("q", w, 1.0) for w in words], "query_id string, term string, tf double")
    return [r.chunk_id for r in search.hybrid_search(dense, q, points, terms, idf, **more).orderBy("rank").collect()]


def test_rare_term_beats_dense_favourite(spark):
    assert hybrid(spark, ["rare"])[0] == "rare"


def test_empty_sparse_and_filters(spark):
    assert hybrid(spark, []) == ["fav", "rare"] and hybrid(spark, ["unknown"]) == ["fav", "rare"]
    assert hybrid(spark, ["rare"], filters={"doc_ids": ["doc-a"]}) == ["fav"]
    with pytest.raises(ValidationError):
        hybrid(spark, ["rare"], weights={"denze": 1.0})


def test_sparse_vectors_are_aligned(spark):
    _, terms, _ = corpus(spark)
    for r in search.sparse_vectors(terms).collect():
        assert len(r["indices"]) == len(r["values"]) and r["indices"] == sorted(set(r["indices"]))


def test_slices_cover_all_queries(spark):
    df = spark.range(100).withColumnRenamed("id", "query_id")
    parts = search.query_slices(df, 30)
    assert len(parts) > 1 and sum(p.count() for p in parts) == 100


def test_chunks_of_paths(spark):
    paths = spark.createDataFrame([("q", 1, ["z"], 0.5), ("q", 2, ["a", "z"], 0.5), ("q", 3, ["m"], 0.9)], "query_id string, path_rank int, chunk_ids array<string>, score double")
    order = lambda by_id: [r.chunk_id for r in chunks_of_paths(paths, by_id=by_id).orderBy("rank").collect()]
    assert order(True) == ["m", "a", "z"] and order(False) == ["m", "z", "a"]


def test_dense_search_equals_a_loop(spark, monkeypatch):
    import math
    import random

    rng = random.Random(5)
    points = [(f"p{i:03d}", [rng.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(4)]) for i in range(300)] + [("zero", [0.0] * 4), ("none", None)]
    queries = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(9)] + [(20, [0.0] * 4)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.dist(a, [0] * 4) * math.dist(b, [0] * 4)) if any(a) and any(b) else 0.0
    want = {}
    for q, v in queries:
        best = sorted(((-round(cos(v, p), 9), k) for k, p in points if p is not None))[:7]
        want[q] = [(k, -s) for s, k in best]
    p = spark.createDataFrame(points, "chunk_id string, dense array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    for rows in (20_000, 3):
        monkeypatch.setattr(search, "QUERY_ROWS", rows)
        got = {}
        for r in search.dense_top_k(q, p, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
        assert got == want
    same = search.dense_top_k(q, p, 7, group_filter=F.lit(True)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, round(r.score, 9)) for r in same] == [(i, s) for i in sorted(want) for _, s in want[i]]
    assert search.dense_top_k(q.filter("query_id > 99"), p, 7).count() == 0
    with pytest.raises(Exception, match="differ in size"):
        search.dense_top_k(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), p, 2).collect()


def test_blocks_and_waves_of_queries_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(500, 8)).round(1)
    rows[100:140] = rows[3]
    points = spark.createDataFrame([(i, i % 3, [float(x) for x in v]) for i, v in enumerate(rows)] + [(900, 0, None)], "chunk_id long, label int, dense array<float>").repartition(4)
    queries = points.filter("chunk_id % 5 = 0 AND dense IS NOT NULL").select(F.col("chunk_id").alias("query_id"), "label", F.col("dense").alias("vector"))
    found = lambda **more: {(r.query_id, r["rank"], r.chunk_id) for r in search.dense_top_k(queries, points, 9, **more).collect()}
    one = found()
    joined = found(group_filter=F.lit(True))
    assert one == joined and len(one) == 100 * 9
    assert found(same="label") == found(group_filter=F.col("q_label") == F.col("label"))
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 8 * 7)
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * 8 * 7 * 4)
    assert found() == one
    with pytest.raises(ValidationError):
        search.dense_top_k(queries.unionByName(spark.createDataFrame([(901, 1, [1.0])], queries.schema)), points, 9)
