from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.config import Chunking
from tidemill.operators.chunking import chunk, edges, spans

PROSE = " ".join(f"Sentence number {i} says a little more than the one before it did." for i in range(120))


def check(text, size, overlap, least):
    rules = Chunking(size, overlap, least)
    got = spans(text, rules)
    assert bool(got) == bool(text)
    if text:
        assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b in got:
        assert 0 < b - a <= size
    for (a, b), (c, d) in zip(got, got[1:], strict=False):
        assert a < c <= b <= d
    return got


def test_overlap_and_size():
    for size, overlap, least in ((400, 80, 50), (500, 100, 50), (900, 150, 80)):
        got = check(PROSE, size, overlap, least)
        assert all(b - c >= overlap for (_, b), (c, _) in zip(got, got[1:], strict=False))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_any_text(text, size, overlap):
    check(text, size, overlap, 4)
    if text:  # an empty one is never cut
        cuts = edges(text, size)
        assert cuts == sorted(set(cuts)) and cuts[0] == 0 and cuts[-1] == len(text)


def test_short_and_hard():
    assert spans("", Chunking()) == [] and spans("Hi.", Chunking()) == [(0, 3)]
    assert spans("x" * 25, Chunking(10, 2, 1)) == [(0, 10), (10, 20), (20, 25)]
    tail = "A sentence of some length here. " * 12 + "Ok."
    assert spans(tail, Chunking(400, 80, 50))[-1][1] == len(tail)


def test_rows_and_pages(spark):
    first, second = PROSE[:300], PROSE[300:700]
    text = first + "\n\n" + second
    rows = spark.createDataFrame([("d", text, [(0, 300), (302, 702)]), ("e", None, []), ("f", "", []), ("g", "🙂 a. " * 60, [])], "doc_id string, text string, page_offsets array<struct<start: int, end: int>>")
    got = chunk(rows, Chunking(200, 40, 30)).collect()
    texts = {"d": text, "g": "🙂 a. " * 60}
    assert {r.doc_id for r in got} == {"d", "g"}
    assert all(texts[r.doc_id][r.char_start : r.char_end] == r.text for r in got)
    assert {r.page for r in got if r.doc_id == "d"} == {1, 2} and {r.page for r in got if r.doc_id == "g"} == {None}
