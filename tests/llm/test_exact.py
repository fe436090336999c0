"""Trained scores and packings against plain versions: no vectors, no batches, every rule written out."""

import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import language as L
from tidemill.llm import quality as Q
from tidemill.llm import toxicity as T
from tidemill.llm.packing import plan_of

from .test_classifiers import sentences

MASK = 2**64 - 1


# -- quality --------------------------------------------------------------------------------------------------------


def plain_curve(points):
    """Isotonic regression by its minimax formula, at each distinct place: [(place, ones, cases of its pool)]."""
    places = sorted({x for x, _ in points})
    ones = [sum(y for x, y in points if x == p) for p in places]
    cases = [sum(x == p for x, _ in points) for p in places]
    mean = lambda a, b: Fraction(sum(ones[a : b + 1]), sum(cases[a : b + 1]))
    n = len(places)
    level = [min(max(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    out = []
    for i, p in enumerate(places):
        own = [k for k in range(n) if level[k] == level[i]]
        out.append((p, sum(ones[k] for k in own), sum(cases[k] for k in own)))
    return out


def plain_chance(curve, x):
    """Linear between a curve's places; each pool's chance drawn half a case towards a half, and never rising."""
    values, low = [], 2.0
    for p, ones, cases in curve:
        low = min(low, (ones + 0.5) / (cases + 1))
        values.append((p, low))
    if x <= values[0][0]:
        return values[0][1]
    for (a, u), (b, v) in itertools.pairwise(values):
        if x <= b:
            return u + (v - u) * (x - a) / (b - a)
    return values[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(0, 1)), min_size=1, max_size=25))
def test_calibration_is_the_isotonic_regression(points):
    x, y = np.array([p[0] for p in points], dtype=float), np.array([p[1] for p in points], dtype=float)
    places, chances = Q.falling(x, y)
    curve = plain_curve(points)
    for at in np.arange(-7, 7, 0.25):
        assert abs(float(np.interp(at, places, chances)) - plain_chance(curve, at)) < 1e-9


def test_quality_scores_equal_a_compressor_loop():
    rng = random.Random(31)
    rows = []
    for i in range(240):
        text = sentences(rng, "en" if i % 4 else "de", rng.randint(1, 30))
        rows.append((text, int(i % 4 > 0)) if rng.random() < 0.95 else ("", i % 2))
    model = Q.fit(rows)

    def difference(text):
        raw, total = text.encode(), 0
        for a in range(0, len(raw), 512):
            for sign, dictionary in ((1, model.good), (-1, model.bad)):
                one = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
                total += sign * len(one.compress(raw[a : a + 512]))
        return total / max(len(raw), 1)

    curve = plain_curve([(difference(t), y) for n, (t, y) in enumerate(rows) if n % 3 == 2])
    for text in ["", "x", *[t for t, _ in rows[:40]], sentences(rng, "en", 400)]:
        got = float(model.scores(np.array([model.sizes(text)]))[0])
        assert abs(got - plain_chance(curve, difference(text))) < 1e-9


# -- toxicity -------------------------------------------------------------------------------------------------------


def plain_sentences(text):
    """Lists of words, each (word, starts where in the bytes, ends where), by the rules that the module states."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words = [(m[0], m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", low)]
    out, last = [], None
    for n, w in enumerate(words):
        marks = sum(low[i] in b"\n!.?" for i in range(w[1]))
        if marks != last:
            begins, last = True, marks
            since = 0
        else:
            since += 1
            begins = since % T.SENTENCE_WORDS == 0
        if begins and (not out or n // T.LEAST_WORDS != out[-1][0]):
            out.append((n // T.LEAST_WORDS, []))
        out[-1][1].append(w)
    return [s for _, s in out], [w for w, _, _ in words]


def plain_toxicity(model, text):
    """(calibrated chance, scores of the sentences, their spans in code points) word by word."""
    found, words = plain_sentences(text)
    z, spans, n = [], [], 0
    for s in found:
        total = float(model.bias)
        for word, _, _ in s:
            if n == 0 or words[n] != words[n - 1]:  # a word that follows itself counts once
                one = features(word)
                total += float(model.weights[one[0]]) + float(model.weights[one[1]])
            n += 1
        z.append(total)
        raw = text.encode()
        spans.append((len(raw[: s[0][1]].decode("utf-8", "ignore")), len(raw[: s[-1][2]].decode("utf-8", "ignore"))))
    p = [1 / (1 + math.exp(-min(max(v, -700), 700))) for v in z]
    log_clean = -sum(math.log1p(math.exp(v)) if v < 30 else v for v in z)
    c = min(max(log_clean, -20), -1e-9)
    odds = math.log(-math.expm1(c)) - c
    return 1 / (1 + math.exp(-(model.slope * odds + model.shift))), p, spans


def features(word):
    """The two feature numbers of a word of lower-cased bytes: the word's and its beginning's."""
    s = T.Sentences(np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)]))
    return int(s.word[0]), int(s.prefix[0])


def test_toxicity_scores_equal_a_word_loop():
    rng = random.Random(32)
    rows = []
    for _ in range(400):
        toxic = rng.random() < 0.4
        text = sentences(rng, rng.choice(["en", "fr", "de"]), rng.randint(1, 8))
        words = text.split()
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "Moron", "brute"]))
        rows.append((" ".join(words), int(toxic)))
    model = T.fit(rows)
    texts = ["", "...", "Idiot", "idiot! IDIOT? idiot.\nidiot", "a " * 130 + "moron moron moron " + "b c " * 60, "é ü. ß! idiot à", *[t for t, _ in rows[:60]]]
    s = T.Sentences(*T.as_run(texts))
    z = s.scores(model.weights, model.bias)
    chance = model.calibrated(s.log_clean(z))
    for d, text in enumerate(texts):
        want, p, spans = plain_toxicity(model, text)
        assert abs(chance[d] - want) < 1e-6
        own = np.flatnonzero(s.doc == d)
        assert np.allclose(T.sigmoid(z[own]), p, atol=1e-6)
        base, points = s_offset(texts, d), text.encode()
        got = [(len(points[: s.begin[k] - base].decode("utf-8", "ignore")), len(points[: s.end[k] - base].decode("utf-8", "ignore"))) for k in own]
        assert got == spans


def s_offset(texts, d):
    return sum(len(t.encode()) for t in texts[:d])


def test_noisy_or_gradient_equals_differences():
    """One step's direction: the loss falls as its numeric derivative says."""
    texts = ["idiot here. and there", "fine words. all good", "moron! idiot!", "good day"]
    y = np.array([1.0, 0.0, 1.0, 0.0])
    s = T.Sentences(*T.as_run(texts))
    rng = np.random.default_rng(1)
    w = rng.normal(scale=0.3, size=T.FEATURES)
    w[-1] = 0

    def loss(v):
        clean = s.log_clean(s.scores(v, -1.0))
        return float(-(y * np.log(-np.expm1(clean)) + (1 - y) * clean).sum() / len(y))

    z = s.scores(w, -1.0)
    clean = s.log_clean(z)
    d = np.where(y > 0, -np.exp(clean) / -np.expm1(clean), 1.0)[s.doc] * T.sigmoid(z) / len(y)
    each = np.repeat(d, np.diff(np.append(s.starts, len(s.word))))
    g = np.bincount(s.word, each, minlength=T.FEATURES) + np.bincount(s.prefix, each, minlength=T.FEATURES)
    for f in {*s.word[:6].tolist(), *s.prefix[:6].tolist()} - {T.FEATURES - 1}:
        step = np.zeros(T.FEATURES)
        step[f] = 1e-5
        assert abs((loss(w + step) - loss(w - step)) / 2e-5 - g[f]) < 1e-6


# -- language -------------------------------------------------------------------------------------------------------


def plain_counts(text):
    codes = [ord(c) for c in text.lower()]
    out = {}
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = sum(codes[i + k] * int(L.MULT[k]) for k in range(n)) & MASK
            h = ((h ^ (h >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n)) & MASK
            f = h >> (64 - 13)
            out[f] = out.get(f, 0) + 1
    return out


def test_gram_counts_equal_a_loop():
    rng = random.Random(33)
    for text in ["", "a", "ab", "Ünïcode 漢字 🙂", sentences(rng, "de", 30)]:
        got = L.counts(text)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == plain_counts(text)


def test_ftrl_equals_a_loop_over_coordinates():
    rng = random.Random(34)
    rows = [(sentences(rng, lang, 2), lang) for _ in range(25) for lang in ("en", "de", "fr")]
    classes = sorted({y for _, y in rows})
    x, y = [], np.array([classes.index(c) for _, c in rows])
    for t, _ in rows:
        c = plain_counts(t)
        norm = math.sqrt(sum(v * v for v in c.values()))
        x.append({f: v / norm for f, v in c.items()})
    alpha, beta, l1, l2, epochs, seed = 0.5, 1.0, 0.002, 0.01, 2, 3
    got, bias = L.ftrl([(np.array(sorted(v)), np.array([v[f] for f in sorted(v)], dtype=np.float64)) for v in x], y, 3, epochs, alpha, beta, l1, l2, seed)

    z, n = {}, {}

    def weight(f, c):
        zf, nf = z.get((f, c), 0.0), n.get((f, c), 0.0)
        one = 0.0 if f == "bias" else l1
        return 0.0 if abs(zf) <= one else -(zf - math.copysign(one, zf)) / ((beta + math.sqrt(nf)) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            own = x[i] | {"bias": 1.0}
            w = {(f, c): weight(f, c) for f in own for c in range(3)}
            logits = [sum(v * w[f, c] for f, v in own.items()) for c in range(3)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            for f, v in own.items():
                for c in range(3):
                    g = v * (e[c] / sum(e) - (1.0 if c == y[i] else 0.0))
                    before = n.get((f, c), 0.0)
                    sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / alpha
                    z[f, c] = z.get((f, c), 0.0) + g - sigma * w[f, c]
                    n[f, c] = before + g * g
    for f, c in z:
        assert abs((bias[c] if f == "bias" else got[f, c]) - weight(f, c)) < 1e-5
    assert 0 < (got != 0).sum() < 3 * len({f for f, _ in z})  # l1 leaves some out


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(35)
    logits = rng.normal(scale=5, size=(200, 4))
    y = np.array([rng.choice(4, p=L.softmax(row / 3)) for row in logits])
    loss = lambda t: -np.log(L.softmax(logits / t)[np.arange(200), y] + 1e-12).mean()
    assert loss(L.temperature_of(logits, y)) <= min(loss(t) for t in np.geomspace(0.05, 15, 200)) + 1e-6


def test_language_predictions_equal_a_loop():
    rng = random.Random(36)
    rows = [(sentences(rng, lang, rng.randint(1, 4)), lang) for _ in range(60) for lang in ("en", "de", "fr")]
    rng.shuffle(rows)
    model = L.fit(rows)
    df = {}
    for t, _ in rows:
        for f in plain_counts(t):
            df[f] = df.get(f, 0) + 1
    for text in [t for t, _ in rows[:20]] + ["xyz", "der und the"]:
        grams = {f: v * (math.log((1 + len(rows)) / (1 + df.get(f, 0))) + 1) for f, v in plain_counts(text).items()}
        norm = math.sqrt(sum(v * v for v in grams.values()))
        logits = [sum(v / norm * float(model.weights[f, c]) for f, v in grams.items()) + float(model.bias[c]) for c in range(3)]
        e = [math.exp((v - max(logits)) / model.temperature) for v in logits]
        lang, score = model.predict(text)
        assert abs(score - max(e) / sum(e)) < 1e-4 and (lang == model.classes[e.index(max(e))] or max(e) / sum(e) < 0.3334)


# -- packing --------------------------------------------------------------------------------------------------------


def fewest(pieces, capacity):
    """The least number of sequences, by trying every place for each piece."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + pieces[i] <= capacity and bins[b] not in bins[:b]:
                put(i + 1, [*bins[:b], bins[b] + pieces[i], *bins[b + 1 :]])
        put(i + 1, [*bins, pieces[i]])

    put(0, [])
    return best


def sequences(counts, capacity):
    return len({sequence + at // per for length, lo, hi, sequence, _, per in plan_of(counts, capacity) for at in range(hi - lo)})


def test_small_histograms_against_the_optimum():
    rng = random.Random(37)
    equal = 0
    for _ in range(300):
        capacity = rng.choice([10, 12, 20])
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {k: pieces.count(k) for k in set(pieces)}
        got, least = sequences(counts, capacity), fewest(pieces, capacity)
        assert least <= got <= least + 1
        equal += got == least
    assert equal >= 285


def test_large_histograms_against_the_bound():
    """At most a hundredth above what the tokens, and the pieces of which no two fit, need."""
    rng = np.random.default_rng(38)
    for lengths in (np.clip(rng.lognormal(5, 1.2, 30_000).astype(int), 1, 1024), rng.integers(1, 1025, 30_000), rng.integers(1, 300, 30_000)):
        values, n = np.unique(lengths, return_counts=True)
        counts = dict(zip(values.tolist(), n.tolist(), strict=True))
        bound = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
        assert sequences(counts, 1024) <= 1.01 * bound
