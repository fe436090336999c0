import random

import numpy as np

from tidemill.llm import neardup as N

from .brute import near

DOCS = "doc_id long, text string, n_shingles int, cells string, a long, b long"


def run(spark, docs, **more):
    got = N.near_duplicates(spark.createDataFrame([(d, t, 1, "c", 2, 3) for d, t in docs], DOCS), **more).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}, got


def edited(rng, words, rate):
    return [rng.choice("pqrstuv") + str(rng.randint(0, 9999)) if rng.random() < rate else w for w in words]


def cases():
    rng = random.Random(8)
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two three four"), (6, "one two three four five"), (7, "x " * 9000)]
    n = 10
    for _ in range(12):
        base = [f"b{rng.randint(0, 5000)}" for _ in range(rng.choice([8, 40, 150, 600]))]
        for _ in range(rng.choice([1, 2, 30])):
            docs.append((n, " ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04, 0.1])))))
            n += 1
    docs += [(n + i, docs[20][1].upper()) for i in range(40)]
    rng.shuffle(docs)
    return docs


def test_equals_brute_force(spark):
    docs = cases()
    got, rows = run(spark, docs)
    assert len(rows) == len(docs) and got == near(docs)
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows)


def test_small_blocks_give_the_same(spark):
    docs = cases()
    assert run(spark, docs, block_docs=4)[0] == near(docs)


def test_repeated_and_nameless_rows(spark):
    text = "a b c d e f g"
    _, rows = run(spark, [(5, text), (5, text), (None, text), (9, text)])
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows if r.doc_id) == [(5, 5, True), (5, 5, True), (9, 5, False)]
    assert [r.kept for r in rows if r.doc_id is None] == [True]


def test_empty(spark):
    assert run(spark, [])[1] == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        a, b = base[:250], base[50:]
        s = N.super_minhash([a, b], 128)
        errors.append((s[0] == s[1]).mean() - 200 / len(base))
    assert abs(np.mean(errors)) < 0.02
    # plain minhash would give 0.0417 here
    assert np.std(errors) < 0.042


def test_each_element_uses_every_place_once():
    one = N.super_minhash([np.array([12345], dtype=np.uint64)], 32)[0]
    assert sorted(int(x) for x in one) == list(range(32))


def test_matrix_and_pairwise_comparison_agree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(70, 100)], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)])) for _ in range(40)]
    ids = list(range(40))

    def classes(links):
        parent = list(range(40))
        for a, b in links:
            x, y = N._root(parent, a), N._root(parent, b)
            parent[max(x, y)] = min(x, y)
        return [N._root(parent, i) for i in ids]

    pairs = [(a, b) for a in ids for b in ids[:a] if N._linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
    links = N.links_of(ids, [0] * 40, [None] * 40, sets)
    assert classes(links) == classes(pairs) and len(links) < 40
    assert set(links) <= {*pairs}


def test_two_sides_and_known_components():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(60, 100)], rng.integers(0, 2**63, rng.integers(0, 25), dtype=np.uint64)])) for _ in range(50)]
    for n in (10, 50):
        ids, sides, known = list(range(n)), [i % 2 for i in range(n)], [None if i % 3 else i % 4 for i in range(n)]
        linked = lambda a, b: N._linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
        true = {(a, b) for a in ids for b in ids[:a] if sides[a] != sides[b] and linked(a, b)}

        def classes(links):
            parent, first = list(ids), {}
            for i in ids:
                if known[i] is not None:
                    parent[i] = first.setdefault(known[i], i)
            for a, b in links:
                x, y = N._root(parent, a), N._root(parent, b)
                parent[max(x, y)] = min(x, y)
            return [N._root(parent, i) for i in ids]

        got = N.links_of(ids, sides, known, sets[:n])
        assert all((max(p), min(p)) in true for p in got) and classes(got) == classes(true)


def grouped(rng, n, rate, length=60):
    base = [f"g{k}" for k in range(length)]
    return [" ".join(edited(rng, base, rate)) for _ in range(n)]


def test_a_group_of_many_blocks_and_components(spark):
    """Members that neither their leader nor their block links are compared with all others."""
    rng = random.Random(9)
    docs = list(enumerate(t for rate in (0.01, 0.03, 0.06) for t in grouped(rng, 120, rate)))
    rng.shuffle(docs)
    for block in (2, 5, 64):
        assert run(spark, docs, block_docs=block)[0] == near(docs)


def test_rows_of_cells_grow_with_the_group(spark, monkeypatch):
    """Near copies of one text: sets are written about once a member, however many blocks there are."""
    rng = random.Random(10)
    written, compared = [], N._compared
    monkeypatch.setattr(N, "_compared", lambda docs, cells, *more: written.append(cells.count()) or compared(docs, cells, *more))
    rows = []
    for n in (200, 800):
        docs = list(enumerate(grouped(rng, n, 0.01, 200)))
        assert run(spark, docs, block_docs=16)[0] == near(docs)
        rows.append(sum(written))
        written.clear()
    # a member is in the groups of a few leaders; with all pairs of blocks the rows would be sixteenfold
    assert rows[1] < 5 * rows[0], rows


def test_cells_of_one_group_go_to_one_task_after_the_other(spark):
    from pyspark.sql import functions as F

    cells = spark.range(40).select(F.lit(7).cast("long").alias("leader"), F.col("id").cast("int").alias("i"))
    slots = [r[0] for r in cells.select(N._slot(F.col("i"), 8)).collect()]
    assert [s - slots[0] for s in slots[:8]] != [0] * 8 and all(slots.count(k) == 5 for k in range(8))
