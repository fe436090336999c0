"""Manifests against a plain tree over all leaves."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tidemill.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes, proofs):
    """Reduce ``nodes`` and append (side, siblings of the run) to the proof of all that lie below each; the node left."""
    below = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_below = [], []
        for i in range(0, len(nodes), 2):
            run, own = nodes[i : i + 2], below[i : i + 2]
            for at, leaves in enumerate(own):
                for k in leaves:
                    proofs[k].append((run[:at], run[at + 1 :]))
            up.append(h(*run))
            up_below.append(sum(own, []))
        nodes, below = up, up_below
    return nodes[0]


def plain(docs):
    trees = {}
    for d in docs:
        trees.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(*d), d))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    subroots, proofs = [], {}
    for t in order:
        trees[t].sort(key=lambda x: x[:3])
        proofs[t] = [[] for _ in trees[t]]
        subroots.append(tree([x[2] for x in trees[t]], proofs[t]))
    upper = [[] for _ in order]
    root = tree(subroots, upper) if order else None
    out = []
    for t, sub, top in zip(order, subroots, upper, strict=True):
        for (_, _, own, d), steps in zip(trees[t], proofs[t], strict=True):
            siblings = [s for a, b in [*steps, *top] for s in [*a, *b]]
            node = leaf(d[0], d[1], d[2], d[3] + 1, d[4]) if d[0] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 else own
            for a, b in [*steps, *top]:
                node = h(*a, node, *b)
            out.append((d[0], own, sub, root, h(*siblings), node, node == root))
    return sorted(out, key=repr)


def rows_of(spark, docs, **how):
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    presented = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = manifest(df, presented, **how)
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def corpus(n, langs=("en", "en", "en", "é", None, "de")):
    return [(i * 7 % n, f"s{i % 3}" if i % 5 else None, langs[i % len(langs)], i if i % 4 else None, f"text {i} ü" if i % 9 else None) for i in range(n)]


def test_several_rounds_of_small_blocks(spark):
    docs = corpus(333)
    assert rows_of(spark, docs, bits=2, top=4) == plain(docs)


def test_one_block_each_and_the_driver_alone_above(spark):
    docs = [*corpus(97), *[(5, "s", "en", 1, "same")] * 3, (None, None, None, None, None), (None, None, "en", 3, ""), (98, "x", "long", 7, "y" * 2_000_000), (99, "x", "one", 7, "")]
    got = rows_of(spark, docs)
    assert got == plain(docs)
    assert {r[6] for r in got} == {True, False}


def test_more_languages_than_the_driver_holds(spark):
    docs = corpus(60, tuple(f"l{k}" for k in range(23)))
    assert rows_of(spark, docs, bits=1, top=3) == plain(docs)


def test_a_single_row_is_its_own_root_and_an_empty_table_has_none(spark):
    docs = [(1, "s", "en", 2, "ab")]
    assert rows_of(spark, docs) == plain(docs) == [(1, leaf(*docs[0]), leaf(*docs[0]), leaf(*docs[0]), h(), leaf(*docs[0]), True)]
    assert rows_of(spark, []) == []


def test_columns_of_the_same_names(spark):
    docs = corpus(40)
    wide = spark.createDataFrame(docs, SCHEMA).withColumn("tree", F.lit(1)).withColumn("node", F.lit("x")).withColumn("place", F.lit(2)).withColumn("leaf", F.lit(3))
    assert {r["root"] for r in manifest(wide).collect()} == {plain(docs)[0][3]}
    assert all(r["verified"] for r in manifest(wide).collect())
