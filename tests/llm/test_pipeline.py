import random

import corpus_pipeline as P

from .brute import contamination, near
from .test_classifiers import sentences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng = random.Random(11)
    items = [(i, " ".join(f"q{i}x{k}" for k in range(20))) for i in range(3)]
    docs, labels, planted = [], [], {"toxic": set(), "junk": set(), "leak": set()}
    for i in range(400):
        text = sentences(rng, rng.choice(["en", "de", "fr"]), rng.randint(8, 20)) + f" unique{i} " + " ".join(f"u{rng.randint(0, 99999)}" for _ in range(60))
        kind = rng.random()
        if kind < 0.15:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "moron"]))
            text, _ = " ".join(words), planted["toxic"].add(i)
        elif kind < 0.3:
            text, _ = " ".join(w + rng.choice(["$$$", "%%%"]) for w in text.split()), planted["junk"].add(i)
        elif kind < 0.36:
            text, _ = text + " " + items[i % 3][1], planted["leak"].add(i)
        docs.append((i, text, "en", "s", len(text)))
        if rng.random() < 0.7:
            labels.append((i, int(i not in planted["junk"]), int(i in planted["toxic"])))
    clean = [r for r in docs if not any(r[0] in p for p in planted.values())][:20]
    docs += [(500 + n, r[1] + " tail", "en", "s", 0) for n, r in enumerate(clean)]
    docs += [(600, None, "en", "s", 0), (601, "", None, None, None)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items, planted


def test_stages_decide_as_planted(spark, tmp_path):
    folder = str(tmp_path)
    docs, items, planted = corpus(spark, folder)
    text = {r[0]: r[1] for r in docs}
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [set(text)]
    for n, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, now, folder).write.parquet(f"{folder}/{n}")
        now = spark.read.parquet(f"{folder}/{n}")
        assert now.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    gone = [a - b for a, b in zip(kept, kept[1:], strict=False)]
    assert planted["toxic"] <= gone[0] | set() and len(gone[0] - planted["toxic"]) <= 4
    junk = planted["junk"] & kept[1]
    assert len(junk - gone[1]) <= 2 and len(gone[1] - junk) <= 4
    groups = near([(d, text[d]) for d in kept[2]])
    assert kept[3] == {d for d, (_, c) in groups.items() if c == d}
    leaks = contamination([(d, text[d]) for d in kept[3]], items)
    assert kept[4] == {d for d, row in leaks.items() if not row[4]} and planted["leak"] & kept[3] <= gone[3]
    pieces = P.STAGES[-1][1](spark, now, folder).collect()
    assert {r.doc_id for r in pieces} == kept[4]


def test_rows_are_decided_one_by_one(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(80))
    other = " ".join(f"v{k}" for k in range(80))
    leak = " ".join(f"q0x{k}" for k in range(20))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, long), (5, long), (None, long + " x"), (3, other), (5, other), (None, "alone " + leak), (None, None), (None, None), (8, ""), (8, ""), (9, ""), (7, "clean words of seven"), (7, "bad " + leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/d")
    kept = P.near_dedup(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path))
    left = [(5, long), (3, other), (None, None), (8, ""), (9, ""), (7, "clean words of seven"), (7, "bad " + leak)]  # the id-less leak goes with its near copy
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(left, key=key)
    clean = P.decontamination(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted((r for r in rows if leak not in (r[1] or "")), key=key)


def test_run_is_its_stages_one_after_the_other(spark, tmp_path):
    """Row by row, and again by a second run in the same shared folder."""
    folder = str(tmp_path)
    corpus(spark, folder)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for n, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, now, folder).write.parquet(f"{folder}/{n}")
        now = spark.read.parquet(f"{folder}/{n}")
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    want = key(P.STAGES[-1][1](spark, now, folder))
    first, second = P.run(spark, folder), P.run(spark, folder)
    assert key(first) == want == key(second)
    sequences = first.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in sequences) <= 1024


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = f"{SCHEMA}, score double, row long, component string, `a.b` string, predicted int, held_out string"
    for name, rows in (("none", []), ("some", [(i, t, "en", "s", 1, 0.5, 7, "c", "x", 1, "h") for i, t in ((1, "a b c"), (2, None), (None, ""), (3, "a b c"))])):
        folder = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(rows, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = docs
        for n, (_, stage) in enumerate(P.STAGES[:-1]):
            stage(spark, now, folder).write.parquet(f"{folder}/{n}")
            now = spark.read.parquet(f"{folder}/{n}")
            assert now.columns == docs.columns
        assert now.count() == (3 if rows else 0)  # of the two equal texts one stays
        assert P.run(spark, folder).count() == (3 if rows else 0)


def test_run_gives_pieces(spark, tmp_path):
    corpus(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(P.run(spark, str(tmp_path)).columns)
