import pytest

from tidemill.errors import ValidationError
from tidemill.operators import graph as G

EDGES = "src_id string, dst_id string, type string, confidence double, chunk_id string, doc_id string"


def start(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "query_id string, entity_id string")


def test_hop_cap(spark):
    edges = spark.createDataFrame([(a, b, "R", 0.9, f"c{a}", "d") for a, b in zip("ABCD", "BCDE", strict=True)], EDGES)
    paths = G.neighbors(start(spark, "A"), edges).collect()
    assert {n for p in paths for n in p.nodes} == {"A", "B", "C"} and {p.hops for p in paths} == {1, 2}


def test_hub_is_capped(spark):
    edges = spark.createDataFrame([("hub", f"n{i}", "R", i / 5000, "c", "d") for i in range(5000)], EDGES)
    paths = G.neighbors(start(spark, "hub"), edges).collect()
    ones = [p for p in paths if p.hops == 1]
    assert 1 <= len(ones) <= 25 and max(p.score for p in ones) == 4999 / 5000


def test_self_loop_counts_once(spark):
    edges = spark.createDataFrame([("A", "A", "R", 0.5, "c", "d"), ("A", "B", "R", 0.4, "c", "d")], EDGES)
    assert G.undirected(edges).count() == 3


def test_path_between(spark):
    edges = spark.createDataFrame([("A", "B", "R", 0.9, "c1", "d"), ("C", "B", "R", 0.5, "c2", "d"), ("A", "D", "R", 0.6, "c3", "d"), ("D", "C", "R", 0.6, "c3", "d")], EDGES)
    pairs = spark.createDataFrame([("ab", "A", "B"), ("ac", "A", "C"), ("aa", "A", "A"), ("ax", "A", "X")], "query_id string, src_id string, dst_id string")
    got = {p.query_id: (p.nodes, p.chunk_ids, p.hops) for p in G.path_between(pairs, edges).collect()}
    assert got == {"ab": (["A", "B"], ["c1"], 1), "ac": (["A", "B", "C"], ["c1", "c2"], 2)}


def test_co_mentions_never_give_the_seed(spark):
    mentions = spark.createDataFrame([("k1", "seed", 0.9, 0), ("k1", "other", 0.8, 5), ("k2", "unrelated", 0.9, 0)], "chunk_id string, entity_id string, confidence double, char_start int")
    got = G.co_mentioned(start(spark, "seed"), mentions).collect()
    assert [(p.nodes, p.chunk_ids, p.hops, p.score) for p in got] == [(["other"], ["k1"], 0, 0.8)]


def test_all_templates(spark):
    edges = spark.createDataFrame([("A", "B", "WORKS_WITH", 0.9, "c", "d")], EDGES)
    mentions = spark.createDataFrame([("c", "A", 0.9, 0), ("c", "B", 0.9, 9)], "chunk_id string, entity_id string, confidence double, char_start int")
    params = {
        "neighbors": start(spark, "A"),
        "path_between": spark.createDataFrame([("q", "A", "B")], "query_id string, src_id string, dst_id string"),
        "entities_by_relation": spark.createDataFrame([("q", "WORKS_WITH")], "query_id string, relation_type string"),
        "co_mentioned": start(spark, "A"),
        "top_entities_for_chunks": spark.createDataFrame([("q", "c")], "query_id string, chunk_id string"),
    }
    assert set(params) == set(G.TEMPLATES)
    for name, p in params.items():
        assert G.traverse(name, p, edges, mentions).count() >= 1, name
    with pytest.raises(ValidationError):
        G.traverse("raw", params["neighbors"], edges, mentions)
