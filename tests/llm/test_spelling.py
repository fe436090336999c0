"""Spelling variants against plain comparison of all words."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm.spelling import Trie, variants, vocabulary

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(docs, typing=97):
    counts = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % typing == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(vocab):
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
    out = []
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], vocab.get(form[w]), root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)


def table(spark, vocab):
    return spark.createDataFrame(sorted(vocab.items()), "word string, n long").repartition(3)


@given(st.sets(st.text("abé", max_size=6), max_size=40))
@settings(max_examples=200, deadline=None)
def test_the_trie_finds_all_pairs_once_from_either_side(strings):
    strings = sorted(strings)
    found = list(Trie(strings).pairs())
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, a in enumerate(strings) for j, b in enumerate(strings) if one_edit(a, b)}


@pytest.mark.parametrize("most", [4096, 3])
def test_all_pairs_of_a_dense_vocabulary(spark, most):
    """Few letters, so that words have many partners and share both halves; groups are split down to the last letters with most = 3."""
    vocab = {w: 3 + zlib.crc32(w.encode()) % 400 for w in ("".join("aé"[(k >> b) & 1] for b in range(n)) for n in (5, 6, 7) for k in range(2**n))}
    vocab |= {"x" * n: 2**n for n in range(5, 20)} | {"ab" * 6: 5, "ab" * 6 + "a": 11}
    assert rows_of(variants(table(spark, vocab), most)) == plain(vocab)


def test_whole_texts_to_roots(spark):
    base = ["harbour", "Harbor", "hárbour", "colour", "color", "cölour", "signal", "signals", "Straße", "strasse"]
    docs = [(i, " ".join(base[(i * k) % len(base)] + ("s" if (i + k) % 11 == 0 else "") for k in range(1, 30)) + f" x{i} tiny 4signal5") for i in range(120)]
    docs += [(None, "colour " * 5), (7, None), (8, ""), (9, "signal"), (9, "signal"), (500, "harbour, " * 200_000), (501, "Ð" * 9 + " " + "Ð" * 9 + "-" + "Ð" * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).withColumn("key", F.lit("k"))
    vocab = vocabulary(df, typing=97)
    assert {r.word: r.n for r in vocab.collect()} == words_of(docs)
    got = rows_of(variants(vocab))
    assert got == plain(words_of(docs))
    assert any(r[3] and r[5] != r[3] for r in got), "a chain of forms"


def test_ties_go_to_the_first_word_and_an_empty_table_has_none(spark):
    vocab = {"abcde": 3, "abcdz": 9, "abcdf": 9, "zzzzz": 3}
    got = rows_of(variants(table(spark, vocab)))
    assert got == plain(vocab)
    assert ("abcde", 3, 2, "abcdf", 9, "abcdf") in got
    assert rows_of(variants(vocabulary(spark.createDataFrame([], "doc_id long, text string")))) == []
