import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import token_counts
from tidemill.llm.packing import pack, plan_of
from tidemill.llm.storage import new_path
from tidemill.llm.token_counts import count_tokens
from tidemill.llm.tokens import ByteBpe

TEXTS = [None, "", "plain words here", "plain words here", "<|endoftext|> inside", "été naïve 漢字 🙂", "x" * 3000, "word " * 4000, "͸ẞ   end", "tabs\t\n\n  and   spaces  "]
SCHEMA = "doc_id long, text string, digest string, length long"  # extra columns with clashing names


def rows():
    return [(i, t, "clash", -1) for i, t in enumerate(TEXTS)]


def test_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = count_tokens(spark.createDataFrame(rows(), SCHEMA), P.path("piece_bpe_32k.model"), limit=100).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        t = TEXTS[r.doc_id] or ""
        n = len(model.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)


def test_cache_holds_each_distinct_text_once(spark):
    cache = new_path(spark, "cache")
    docs = spark.createDataFrame(rows(), SCHEMA)
    first = {(r.doc_id, r.n_tokens) for r in count_tokens(docs.filter("doc_id < 5"), P.path("piece_bpe_32k.model"), cache).collect()}
    both = {(r.doc_id, r.n_tokens) for r in count_tokens(docs, P.path("piece_bpe_32k.model"), cache).collect()}
    assert first < both and len(both) == len(TEXTS)
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})


def test_runs_that_start_together_count_each_text_once(spark, monkeypatch):
    """Both look up before either appends; the later one and a third run find every digest twice."""
    cache, path = new_path(spark, "cache"), P.path("piece_bpe_32k.model")
    docs = spark.createDataFrame(rows(), SCHEMA)
    want = sorted((r.doc_id, r.n_tokens) for r in count_tokens(docs, path).collect())
    look, others = token_counts.stored, []

    def late(*args):
        found = look(*args)
        if not others:
            others.append(None)
            others[0] = sorted((r.doc_id, r.n_tokens) for r in count_tokens(docs, path, cache).collect())
        return found

    monkeypatch.setattr(token_counts, "stored", late)
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(docs, path, cache).collect()) == want == others[0]
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(docs, path, cache).collect()) == want
    distinct = len({t or "" for t in TEXTS})
    assert spark.read.parquet(cache).count() == 2 * distinct


def test_long_texts_and_rows_without_an_id(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    long = "a word and ünother one, " * 60_000  # above a run of bytes
    docs = spark.createDataFrame([(None, long), (None, "x"), (None, "x"), (1, long), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(docs, P.path("piece_bpe_32k.model")).collect())
    n = len(model.encode(long))
    assert got == sorted([(0, len(long.encode()), n), (1, len(long.encode()), n), (0, 1, 1), (0, 1, 1), (0, 0, 0)])
    pieces = pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sum(r.length for r in pieces if r.doc_id is None) == sum(r.length for r in pieces if r.doc_id == 1) + 2 + 2 + 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0
    assert pack(none, P.path("byte_bpe_50k.json")).count() == 0


def test_rank_file_gives_the_same_ids():
    model = ByteBpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.characters(max_codepoint=0x23F), max_size=200))
    def same(text):
        assert model.ids(text, True).tolist() == model.model.encode(text, add_special_tokens=False).ids

    same()
    for text in TEXTS:
        assert model.ids(text or "", True).tolist() == model.model.encode(text or "", add_special_tokens=False).ids


def test_pack_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = pack(spark.createDataFrame(rows() * 2, SCHEMA), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    docs, bins = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(docs[i], key=lambda r: r.piece)[::2]  # each row came twice
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == 1024 for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plan_places_every_piece_once(counts):
    plan = plan_of(counts, 64)
    bins, seen = defaultdict(list), defaultdict(set)
    for length, lo, hi, sequence, offset, per in plan:
        for rank in range(lo, hi):
            at = rank - lo
            assert rank not in seen[length]
            seen[length].add(rank)
            bins[sequence + at // per].append((offset + at % per * length, length))
    assert {k: len(v) for k, v in seen.items()} == counts
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
        assert sum(length > 21 for _, length in own) <= 2
    total = sum(k * n for k, n in counts.items())
    assert len(bins) <= 11 / 9 * -(-total // 64) + sum(n for k, n in counts.items() if k > 21) + 1
