import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.llm.labelled import sample
from tidemill.llm.language import identify_language
from tidemill.llm.quality import BLOCK, dictionary_of, score_quality
from tidemill.llm.toxicity import score_toxicity

VOCABULARY = {
    "en": "the of and to in that is was for with they this from have which were there would".split(),
    "de": "der die und das ist nicht mit sich auf dem eine auch werden über für schön".split(),
    "fr": "le les des est une dans que pour qui sur avec plus été être à même".split(),
}


def sentences(rng, lang, n):
    return " ".join(" ".join(rng.choices(VOCABULARY[lang], k=rng.randint(5, 12))).capitalize() + "." for _ in range(n))


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_language(spark):
    rng = random.Random(1)
    docs = [(i, sentences(rng, lang, rng.randint(1, 6)), lang, 9.0) for i in range(300) for lang in [rng.choice(list(VOCABULARY))]]
    more = [(1000, None, "en", 0.0), (1001, "", "en", 0.0), (1002, "12 !? 34", "de", 0.0), (1003, "the " * 50_000, None, 0.0), (1003, "the " * 50_000, None, 0.0)]
    got = identify_language(spark.createDataFrame(docs + more, "doc_id long, text string, lang string, score double")).collect()
    assert len(got) == 305
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en"
    held = [(by[i].lang_pred, lang) for i, _, lang, _ in docs if crc(i, 4) == 2]
    assert sum(a == b for a, b in held) > 0.97 * len(held)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)


def test_language_without_labels(spark):
    got = identify_language(spark.createDataFrame([(1, "the cat", None)], "doc_id long, text string, lang string")).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)
    assert identify_language(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = sentences(rng, "en", rng.randint(2, 10))
        docs.append((i, text if good else " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in text.split()), "kept", 5))
        labels.append((i, int(good), "x"))
    docs += [(900, None, "kept", 5), (901, "", "kept", 5), (902, "the and of " * 30_000, "kept", 5), (None, "the", "kept", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, `a.b` string, predicted int")
    got = score_quality(d, d, spark.createDataFrame(labels, "doc_id long, quality int, text string"))
    assert got.columns.count("predicted") == 1 and "a.b" in got.columns
    rows = got.collect()
    assert len(rows) == len(docs)
    truth = {i: q for i, q, _ in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.doc_id in truth and r.held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_and_its_places(spark):
    rng = random.Random(3)
    docs, labels, bad = [], [], {}
    for i in range(500):
        parts = [sentences(rng, rng.choice(["en", "fr"]), 1) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            k = rng.randrange(len(parts))
            words = parts[k][:-1].split()
            words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "moron", "brutadas", "brutillo"]))
            parts[k] = " ".join(words) + "."
            bad[i] = parts[k]
        docs.append((i, " ".join(parts), "s"))
        labels.append((i, int(i in bad)))
    docs += [(900, None, "s"), (901, "", "s"), (902, "...", "s"), (903, "the of and. " * 20_000, "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    rows = score_toxicity(d, d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and r.doc_id < 500]
    assert len(held) > 80 and sum(r.predicted == (r.doc_id in bad) for r in held) > 0.97 * len(held)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (900, 901, 902))
    text = {i: t for i, t, _ in docs}
    found = [text[r.doc_id][s.start : s.end] for r in held if r.doc_id in bad for s in r.spans]
    assert found and sum(any(w in f for w in ("idiot", "moron", "brut")) for f in found) > 0.95 * len(found)


def test_every_toxic_document_has_a_place(spark):
    """Also where no sentence alone would do: mild words of several sentences add up."""
    rng = random.Random(13)
    docs, labels = [], []
    for i in range(400):
        parts = [sentences(rng, "en", 1) for _ in range(rng.randint(2, 10))]
        toxic = rng.random() < 0.4
        if toxic:
            for k in rng.sample(range(len(parts)), min(len(parts), rng.randint(1, 4))):
                parts[k] = parts[k][:-1] + " " + rng.choice(["dolt", "fool", "clod", "oaf"]) + "."
        elif rng.random() < 0.3:  # such a word may stand in a clean document too
            parts[0] = parts[0][:-1] + " " + rng.choice(["dolt", "fool", "clod", "oaf"]) + "."
        docs.append((i, " ".join(parts)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = score_toxicity(d, d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert any(r.predicted for r in rows) and not all(r.predicted for r in rows)
    for r in rows:
        assert not r.predicted or r.spans
        assert all(0 <= s.start < s.end <= len(docs[r.doc_id][1]) for s in r.spans)


def test_one_class_or_none(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, 0), (None, 1), (2, None)]):
        labels = spark.createDataFrame([(i, v, v) for i, v in rows], "doc_id long, quality int, toxic int")
        assert score_quality(d, d, labels).count() == 2
        assert score_toxicity(d, d, labels).count() == 2
    none = d.filter("doc_id > 5")
    assert score_quality(none, none, labels).count() == 0 and score_toxicity(none, none, labels).count() == 0


def drawn_first(spark, n):
    """Ids of 0..n-1 that no fit here leaves out, in the order of the draw."""
    ids = [r.id for r in spark.range(n).orderBy(F.xxhash64("id", F.lit(17))).collect()]
    return [i for i in ids if crc(i, 5) != 0 and crc(i, 4) != 2]


def test_a_text_longer_than_the_sample_does_not_end_it(spark):
    rng = random.Random(4)
    first = drawn_first(spark, 300)[0]
    docs, labels = [], []
    for i in range(300):
        good = i % 2
        text = sentences(rng, "en" if good else "de", rng.randint(2, 6))
        text += "" if good else " $$$ %%% idiot moron."
        docs.append((i, text + (" " + "x" * 300_000 if i == first else ""), "en" if good else "de"))
        labels.append((i, good, 1 - good))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t, lang) for (i, q, t), (_, _, lang) in zip(labels, docs, strict=True)}
    for got, place in (
        (score_quality(d, d, given, sample_bytes=200_000).select("doc_id", "predicted"), 0),
        (score_toxicity(d, d, given, sample_bytes=200_000).select("doc_id", "predicted"), 1),
        (identify_language(d, sample_bytes=200_000).select("doc_id", "lang_pred"), 2),
    ):
        rows = [r for r in got.collect() if r[0] != first]
        assert sum(r[1] == truth[r[0]][place] for r in rows) > 0.9 * len(rows)


def test_a_sample_leaves_out_only_texts_that_do_not_fit(spark):
    ids = drawn_first(spark, 200)[:100]
    # long texts are drawn first: one alone above the bound, two of which one fits
    sizes = {ids[0]: 20_000, ids[1]: 6_000, ids[2]: 5_000} | dict.fromkeys(ids[3:], 50)
    docs = [(i, chr(97 + n % 26) * sizes[i], 1) for n, i in enumerate(ids)]
    d = spark.createDataFrame(docs, "doc_id long, text string, y int")
    got = [len(r.text) for r in sample(d, None, "y", F.lit(True), 1000, 10_000).collect()]
    assert got == [5_000] + [50] * 97
    assert [r.text for r in sample(d, None, "y", F.lit(True), 1000, 1 << 20).collect()] == [t for _, t, _ in docs]


def test_a_dictionary_is_trained_on_all_texts(monkeypatch):
    texts = [chr(97 + n) * (BLOCK * 5000 if n == 0 else BLOCK * 2 + 5) for n in range(20)]
    seen = []

    class Trained:
        def as_bytes(self):
            return b"d"

    monkeypatch.setattr("tidemill.llm.quality.zstandard.train_dictionary", lambda size, pieces, **more: seen.append(pieces) or Trained())
    assert dictionary_of(texts) == b"d" and dictionary_of(texts, 30 * BLOCK) == b"d"
    for pieces, bound in zip(seen, (100 * 65536, 30 * BLOCK), strict=True):
        assert {p[:1] for p in pieces} == {t[:1].encode() for t in texts}
        assert bound - BLOCK < sum(map(len, pieces)) <= bound


def test_only_chosen_texts_meet_in_one_task(spark):
    """A thousand labelled texts of 1 MB and a bound of 16 MB: sizes decide, and the task that fits reads the bound at most."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 1 << 17).alias("text"), F.lit("x").alias("y"))
    chosen = sample(docs.repartition(8), None, "y", F.lit(True), 1000, 16 << 20)

    def measured(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.as_py()) for b in batches for t in b.column(0))])], names=["bytes"])

    sizes = [r.bytes for r in chosen.mapInArrow(measured, "bytes long").collect()]
    assert len(sizes) == 1 and (14 << 20) < sizes[0] <= 16 << 20
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "text" not in window[: window.index("\n")]


def test_repeated_rows_are_chosen_together(spark):
    docs = spark.createDataFrame([(1, "a" * 10, "x")] * 3 + [(1, "b" * 10, "x"), (2, None, "x"), (3, "c" * 1000, "x")], "doc_id long, text string, y string")
    assert sorted(r.text for r in sample(docs, None, "y", F.lit(True), 10, 100).collect()) == ["", *["a" * 10] * 3, "b" * 10]
