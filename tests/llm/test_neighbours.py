import math

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm.neighbours import nearest, rows_of

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k=10):
    good = {}
    for i, v, *_ in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, dtype=np.float32).astype(np.float64))
    out = []
    for q in good:
        if q % 7 == 0:
            found = sorted((min(float(np.sqrt(((good[q][0] - x) ** 2).sum())) for x in xs if len(x) == len(good[q][0])), c) for c, xs in good.items() if c != q and any(len(x) == len(good[q][0]) for x in xs))
            out += [(q, r + 1, c, round(d, 9)) for r, (d, c) in enumerate(found[:k])]
    return sorted(out)


def check(spark, rows, **more):
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0, **more).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == brute(rows)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).tolist(), 0, "") for i in range(300)]
    check(spark, rows, block=32, wave_bytes=1)


def test_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0], 0, "") for i in range(40)] + [(100 + i, rng.normal(size=3).tolist(), 0, "") for i in range(30)]
    rows += [(200, None, 0, ""), (201, [0.0, 0.0, 0.0], 0, ""), (203, [float("nan"), 1.0, 1.0], 0, ""), (204, [float("inf"), 1.0, 1.0], 0, ""), (210, [None, 1.0, 2.0], 0, ""), (211, [], 0, ""), (217, [1.0, 2.0], 0, ""), (218, [1.0, 2.5], 0, "")]
    rows += [(5, [1.0, 2.0, 3.0], 0, ""), (14, [1.0, 2.0, 3.0], 0, "")]
    check(spark, rows, block=16)


def test_rows_that_repeat_an_id_do_not_tighten_the_bound(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist(), 0, "") for i in range(60)]
    # one id stands more than k times near a query
    near = [(1, (np.array(rows[0][1]) + 1e-3 * n).tolist(), 0, "") for n in range(25)]
    for case in (rows * 2, rows + near):
        one = spark.createDataFrame(case, SCHEMA).coalesce(1)  # all in one block
        got = nearest(one, F.col("vec_id") % 7 == 0).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == brute(case)


def test_an_id_with_a_bad_and_a_good_row_is_searched(spark):
    rows = [(0, [1.0, 0.0], 0, ""), (0, [0.0, 0.0], 0, ""), (7, None, 0, ""), (7, [2.0, 2.0], 0, ""), (7, [float("nan"), 0.0], 0, ""), (3, [1.0, 1.0], 0, ""), (14, [float("-inf"), 1.0], 0, ""), (None, [1.0, 1.0], 0, "")]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == brute([r for r in rows if r[0] is not None])
    assert {r.query_id for r in got} == {0, 7}


def test_wide_vectors_make_smaller_blocks(spark):
    assert rows_of(64, 2048, 4 << 20) == 2048 and rows_of(1 << 16, 2048, 4 << 20) == 8 and rows_of(1 << 30, 2048, 4 << 20) == 1
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=50).tolist(), 0, "") for i in range(120)]
    check(spark, rows, block_bytes=3 * 8 * 50, wave_bytes=1)


def test_components_whose_squares_overflow(spark):
    """Such vectors are at an infinite distance, and hide no others."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(40 + i, [1e200 * (i + 1), 0.0, 1.0, 0.0]) for i in range(5)] + [(49, [1e200, 0.0, 1.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 0, k=40, block=8).collect()
    vectors = {i: np.array(v) for i, v in rows}
    with np.errstate(over="ignore"):
        for q in (0, 7, 42, 49):
            best = sorted((float(np.sqrt(((vectors[q] - x) ** 2).sum())), i) for i, x in vectors.items() if i != q)
            assert [(r.vec_id, r["rank"]) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, n + 1) for n, (_, i) in enumerate(best)]


def test_empty(spark):
    check(spark, [])
    check(spark, [(7, [1.0], 0, "")])
