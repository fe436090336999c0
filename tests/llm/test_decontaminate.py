import random

import pytest

from tidemill.llm import decontaminate as D
from tidemill.llm import registry

from .brute import contamination

DOCS = "doc_id long, text string, words string, items string, span int, shingle string"
ITEMS = "item_id long, text string, words string"


def run(spark, docs, items, **more):
    got = D.decontaminate(spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in docs], DOCS), spark.createDataFrame([(i, t, "w") for i, t in items], ITEMS), **more).collect()
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got}, len(got)


def cases():
    rng = random.Random(4)
    vocabulary = ["The", "of", "and", "été", "Zürich", "a1", "x", "straße", "É"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "... !"), (53, items[6][1]), (54, "the the the the the the the the the the the"), (55, "Short item")]
    docs = [(100, None), (101, ""), (102, "?!"), (103, "only")]
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(1, 80))
        for _ in range(rng.randint(0, 3)):
            words[rng.randint(0, len(words)) : 0] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    docs += [(104, docs[10][1]), (105, "the " * 500), (106, (items[5][1] + " ") * 300)]
    return docs, items


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_equals_brute_force(spark, limit):
    docs, items = cases()
    got, n = run(spark, docs, items, broadcast_bytes=limit)
    assert n == len(docs) and got == contamination(docs, items)


def test_repeated_rows_are_one_document(spark):
    docs, items = [(1, "a b c"), (1, "a b c"), (2, None)], [(7, "b c")]
    got, n = run(spark, docs, items)
    assert n == 2 and got == contamination(docs, items)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_each_row_and_rows_without_an_id(spark, limit):
    docs = [(1, "a b c b c"), (1, "a b c b c"), (1, "x"), (None, "b c"), (None, "b c"), (None, "x"), (2, None), (2, None), (3, "k b c")]
    items = [(7, "b c"), (8, "b c"), (9, "k"), (10, "c b c")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for n, (i, text) in enumerate(docs):
        want.append((i is None, i or 0, *contamination([(n, text)], items)[n]))
    for each, expected in ((True, want), (False, set(want))):
        got = D.decontaminate(d, b, broadcast_bytes=limit, each_row=each).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(expected)
    none = D.decontaminate(d, b.filter("item_id < 0"), broadcast_bytes=limit)
    assert none.count() == len(set(docs))


def test_the_query_reports_each_row(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = registry.op1_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in rows) == [(0, 2), (1, 2), (1, 2)]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")])[1] == 0
    docs = [(1, "a b"), (2, None)]
    for items in ([], [(1, None)]):
        assert run(spark, docs, items)[0] == contamination(docs, items)
