import hashlib
import unicodedata
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import identity as I
from tidemill.functions import text as T

SUFFIXES, HONORIFICS = ("inc", "inc.", "ltd", "corp", "corporation", "private limited", "co."), ("mr", "dr", "sir")


@given(st.text())
def test_normal_form_is_idempotent(text):
    once = I.normal_form(text)
    assert I.normal_form(once) == once


def test_forms_that_name_one_text():
    same = ["hello world", "hello world", "hello\tworld", "Hello\n\n  world ", "ｈello world"]
    assert {I.normal_form(t) for t in same} == {"hello world"}
    assert I.normal_form("hello​world﻿") == "helloworld"


def test_columns_equal_python(spark):
    texts = ["", " A\x1cb ", "Straße", "ﬁne ‍ print", "ＡＢＣ", "tab\tline\n", "emoji 🙂 x", "É", "İstanbul", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", I.content_hash(F.col("t")).alias("h"), I.chunk_id(F.col("t")).alias("c"), I.entity_id(F.col("t"), F.lit("ORG")).alias("e"), I.document_id(F.encode("t", "UTF-8")).alias("d")).collect()
    for r in rows:
        if r.t is None:
            assert r.h is None
            continue
        digest = hashlib.sha256(I.normal_form(r.t).encode())
        assert r.h == digest.hexdigest()
        assert r.c == str(uuid.UUID(bytes=digest.digest()[:16], version=5))
        assert r.e == str(uuid.UUID(bytes=hashlib.sha256(f"{I.normal_form(r.t)}\x1fORG".encode()).digest()[:16], version=5))
        assert r.d == str(uuid.UUID(bytes=hashlib.sha256(r.t.encode()).digest()[:16], version=5))


def test_correlation_ids_sort_by_time():
    a, b = I.new_correlation_id(1_700_000_000_000), I.new_correlation_id(1_700_000_000_001)
    assert len(a) == 26 and a < b and set(a) <= set(I.CROCKFORD)
    assert I.new_correlation_id(0, b"\0" * 9 + b"\1") == "0" * 25 + "1"


def test_display_form(spark):
    texts = ["a\r\nb\rc", "x\x00\x07y\x85z", "é", "keep \t\n  runs"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_display(F.col("t"))).collect()]
    assert got == ["a\nb\nc", "xyz", unicodedata.normalize("NFC", "é"), "keep \t\n  runs"]


def test_entity_names():
    cases = {"Acme Corp.": "acme", "ACME Corporation": "acme", "Acme": "acme", "Dr. J. Smith": "j smith", "Corporation Street": "corporation street", "Acme Private Limited Inc.": "acme", "Sir Dr. Who": "who"}
    assert {n: T.entity_name(n, SUFFIXES, HONORIFICS) for n in cases} == cases
    assert T.entity_name("Inc.", SUFFIXES, HONORIFICS) == "inc" and T.entity_name("!!!", SUFFIXES, HONORIFICS) == "!!!" and T.entity_name("Mr", SUFFIXES, HONORIFICS) == "mr"


@settings(max_examples=200)
@given(st.text(min_size=1))
def test_entity_names_are_never_empty_and_stable(name):
    once = T.entity_name(name, SUFFIXES, HONORIFICS)
    assert once
    if T.cleaned(name):
        assert T.entity_name(once, SUFFIXES, HONORIFICS) == once
