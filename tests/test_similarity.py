import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.config import Resolution
from tidemill.functions import similarity as S

NAMES = st.text(alphabet="abcd ", max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(NAMES, NAMES)
def test_common_subsequence(a, b):
    assert S.common_subsequence(a, b) == lcs(a, b)


@given(NAMES, NAMES)
def test_symmetric_and_bounded(a, b):
    for f in (S.jaro_winkler_of, S.token_set_of):
        assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 1


def test_known_values():
    assert S.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro_winkler_of("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert S.jaro_winkler_of("", "") == 1 and S.jaro_winkler_of("", "a") == 0
    assert S.token_set_of("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert S.token_set_of("", "") == 0
    assert S.token_set_of("new york mets", "new york yankees") == pytest.approx(1 - 5 / 21, abs=0.05)


def test_scores_and_bands(spark):
    rules = Resolution()
    rows = spark.createDataFrame([("acme", "acme", "ORG", "ORG", 1.0), ("acme", "acme", "ORG", "PER", 1.0), ("a b", "c d", "ORG", "ORG", -1.0)], "a string, b string, x string, y string, c double")
    got = [r[0] for r in rows.select(S.score_pair(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.col("c"), rules)).collect()]
    assert got[0] > 0.99 and got[1:] == [0.0, 0.0]
    scores = [0.90, 0.65, 0.899999, 0.650001, 1.0, 0.0]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in scores], "s double").select(S.band(F.col("s"), rules)).collect()] == ["merge", "reject", "gray", "gray", "merge", "reject"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in rows.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    with pytest.raises(Exception, match="differ in size"):
        spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<float>, b array<float>").select(S.cosine(F.col("a"), F.col("b"))).collect()
