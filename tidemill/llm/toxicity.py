"""Toxicity by multiple-instance learning.

Only documents carry labels.  Every sentence gets a logistic score from its words and word beginnings, and a
document is toxic unless all its sentences are not: P = 1 - prod(1 - p) (noisy-or).  The likelihood of the
document labels trains the sentence scores, which then tell where a document offends: the sentences that would
make it toxic alone, or else, where only many together do, its worst one.  A run of more than
``SENTENCE_WORDS`` words without an end mark counts as several sentences; sentences that begin within the same
``LEAST_WORDS`` words of a document count as one, so that shouted single words do not add up; a word that
follows itself counts once.

Edge cases: a null, empty or wordless text has no sentences, so P is 0 before calibration; with one class or
none among the labels the score is the share of label 1 (0 without labels), which locates nothing in a text without
sentences; whole texts are used; repeated rows are
each reported; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, U, Words, chunks
from .labelled import fitted, held_out, sample, scored

BITS, PREFIX, SENTENCE_WORDS, LEAST_WORDS = 18, 4, 40, 8
FEATURES = (2 << BITS) + 1  # the last stands for a repeated word and has no weight
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 20 << 20
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_END = np.zeros(256, dtype=bool)
IS_END[[10, 33, 46, 63]] = True


class Sentences:
    """Feature numbers of a run of documents, cut into sentences."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, IS_WORD, PREFIX)
        shift = U(64 - BITS)
        self.word = (words.hashes >> shift).astype(np.int32)
        self.prefix = (words.prefixes >> shift).astype(np.int32) + np.int32(1 << BITS)
        n = len(self.word)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
        if n:
            again = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])) + 1
            self.word[again] = self.prefix[again] = FEATURES - 1
        ends = np.cumsum(IS_END[LOWER[data]]) if len(data) else np.zeros(0, np.int64)
        part = ends[words.starts] if n else np.zeros(0, np.int64)
        new = np.ones(n, dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        within = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        cut = np.flatnonzero(within % SENTENCE_WORDS == 0)
        grid = (cut - words.bounds[doc[cut]]) // LEAST_WORDS
        first = np.ones(len(cut), dtype=bool)
        first[1:] = (grid[1:] != grid[:-1]) | (doc[cut][1:] != doc[cut][:-1])
        self.starts = cut[first]
        self.doc = doc[self.starts]
        self.begin, self.end = words.starts[self.starts], words.ends[np.append(self.starts[1:], n) - 1] if n else words.starts
        self.docs = len(offsets) - 1

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0)
        return np.add.reduceat(weights[self.word].astype(np.float64) + weights[self.prefix], self.starts) + bias

    def log_clean(self, z: np.ndarray) -> np.ndarray:
        """log of the product of (1 - p) over each document's sentences."""
        return -np.bincount(self.doc, np.logaddexp(0, z), minlength=self.docs)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def calibrated(self, log_clean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * log_odds(log_clean) + self.shift, -30, 30)))


def log_odds(log_clean: np.ndarray) -> np.ndarray:
    """log(P / (1 - P)) for log(1 - P) = log_clean, kept within +-20."""
    c = np.clip(log_clean, -20, -1e-9)
    return np.log(-np.expm1(c)) - c


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def as_run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def train(batches: list[tuple[Sentences, np.ndarray]], steps: int = 300, rate: float = 1.0, l1: float = 2e-4, least: int = 4) -> tuple[np.ndarray, float]:
    """About ``steps`` Adagrad steps with l1 on the noisy-or likelihood; features of fewer than ``least`` documents stay 0.

    Weights are not negative: harmless words must not make up for an offence in the same sentence.
    """
    size = FEATURES
    seen = np.zeros(size, dtype=np.int64)
    for s, _ in batches:
        owner = np.repeat(s.doc, np.diff(np.append(s.starts, len(s.word))))
        for f in (s.word, s.prefix):
            seen += np.bincount(np.unique(owner * size + f) % size, minlength=size)
    live = seen >= least
    live[-1] = False
    w, g2, bias, b2 = np.zeros(size), np.full(size, 1e-6), -4.0, 1e-6
    for _ in range(-(-steps // max(1, len(batches)))):
        for s, y in batches:
            z = s.scores(w, bias)
            clean = np.clip(s.log_clean(z), -30, -1e-9)
            odds = np.where(y > 0, -np.exp(clean) / -np.expm1(clean), 1.0)  # -(1-P)/P where toxic
            d = odds[s.doc] * sigmoid(z) / len(y)
            each = np.repeat(d, np.diff(np.append(s.starts, len(s.word))))
            g = np.bincount(s.word, each, minlength=size) + np.bincount(s.prefix, each, minlength=size)
            g[~live] = 0
            g2 += g * g
            step = rate / np.sqrt(g2)
            w = w - np.where(live, step * g, 0)
            w = np.maximum(w - step * l1 * live, 0)
            total = d.sum()
            b2 += total * total
            bias -= rate / np.sqrt(b2) * total
    return w, float(bias)


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Slope and shift of a logistic calibration, drawn a little towards (1, 0), by damped Newton steps."""
    theta = np.array([1.0, 0.0])

    def loss(t: np.ndarray) -> float:
        z = t[0] * x + t[1]
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + ridge / 2 * ((t - [1.0, 0.0]) ** 2).sum())

    for _ in range(100):
        p = sigmoid(theta[0] * x + theta[1])
        h = p * (1 - p)
        grad = np.array([((p - y) * x).sum(), (p - y).sum()]) + ridge * (theta - [1.0, 0.0])
        move = np.linalg.solve(np.array([[(h * x * x).sum() + ridge, (h * x).sum()], [(h * x).sum(), h.sum() + ridge]]), grad)
        size = 1.0
        while size > 1e-6 and loss(theta - size * move) > loss(theta):
            size /= 2
        theta = theta - size * move
        if np.abs(size * move).max() < 1e-8:
            break
    return theta


def fit(rows: list[tuple[str, object]], batch: int = 256) -> Model:
    """Weights from four fifths of the rows, calibration on the rest."""
    y = np.array([int(v) for _, v in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        return Model(np.zeros(FEATURES), -30.0, 0.0, float(np.log(share / (1 - share))))
    last = np.arange(len(rows)) % 5 == 4
    if len(set(y[last].tolist())) < 2 or len(set(y[~last].tolist())) < 2:
        last = np.zeros(len(rows), dtype=bool)
    own = [i for i in range(len(rows)) if not last[i]]
    batches = []
    for a in range(0, len(own), batch):
        s = Sentences(*as_run([rows[i][0] for i in own[a : a + batch]]))
        s.begin = s.end = None  # training needs no places
        batches.append((s, y[own[a : a + batch]]))
    w, bias = train(batches)
    w = w.astype(np.float32)
    model = Model(w, bias, 1.0, 0.0)
    if last.any():
        kept = [i for i in range(len(rows)) if last[i]]
        s = Sentences(*as_run([rows[i][0] for i in kept]))
        x = log_odds(s.log_clean(s.scores(w, bias)))
        theta = platt(x, y[last])
        if theta[0] > 0:
            model.slope, model.shift = float(theta[0]), float(theta[1])
    return model


SPANS = "array<struct<start: int, end: int, score: double>>"


def least_alone(model: Model, threshold: float) -> float:
    """The least sentence score, as log-odds, with which a document of one sentence reaches the threshold."""
    lo, hi = -50.0, 50.0
    reaches = lambda z: float(model.calibrated(-np.logaddexp(0, np.array([z])))[0]) >= threshold
    if reaches(lo) or not reaches(hi):
        return -np.inf if reaches(lo) else np.inf
    while hi - lo > 1e-12:
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if reaches(mid) else (mid, hi)
    return hi


def located(s: Sentences, z: np.ndarray, chance: np.ndarray, least: float, threshold: float) -> np.ndarray:
    """Numbers of the offending sentences, in order.

    A sentence offends if its score is ``least`` or more, so that it would do alone; in a document that reaches the
    threshold by several sentences only, the first of the greatest score does.
    """
    hit = z >= least
    if len(z):
        first = np.flatnonzero(np.append(True, s.doc[1:] != s.doc[:-1]))
        doc = s.doc[first]
        bare = (chance[doc] >= threshold) & ~np.logical_or.reduceat(hit, first)
        ends = np.append(first[1:], len(z))
        for a, b in zip(first[bare].tolist(), ends[bare].tolist(), strict=True):
            hit[a + int(z[a:b].argmax())] = True
    return np.flatnonzero(hit)


def _score(model: Model, threshold: float):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    added = [pa.field("score", pa.float64()), pa.field("spans", pa.list_(span))]

    least = least_alone(model, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*list(batch.schema)[1:], *added])
            for lo, hi, data, offsets in chunks(batch.column(0)):
                s = Sentences(data, offsets)
                z = s.scores(model.weights, model.bias)
                chance = model.calibrated(s.log_clean(z))
                hit = located(s, z, chance, least, threshold)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin = points[s.begin[hit]] - points[offsets[s.doc[hit]]]
                end = points[s.end[hit]] - points[offsets[s.doc[hit]]]
                rows = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(sigmoid(z[hit]))], fields=list(span))
                cuts = np.searchsorted(s.doc[hit], np.arange(hi - lo + 1)).astype(np.int32)
                kept = [batch.column(k).slice(lo, hi - lo) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(chance), pa.ListArray.from_arrays(pa.array(cuts), rows)], schema=schema)

    return run


def score_toxicity(documents: DataFrame, training: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``documents`` (doc_id, text, ...): its columns with held_out, score, predicted and spans.

    ``spans`` are the sentences that offend, in code points, each with its own score; a row with predicted 1 has one at
    least if its text has a word.  The fit joins ``training`` (doc_id,
    text) with ``labels`` (doc_id, toxic) where crc32(doc_id) mod ``modulus`` is not ``remainder``, and takes at most
    ``sample_rows`` rows and ``sample_bytes``.  Columns of ``documents`` with one of the added names are replaced.
    """
    model = fitted(sample(training, labels, "toxic", ~held_out(F.col("doc_id"), modulus, remainder), sample_rows, sample_bytes), fit)
    got = scored(documents, ["score double", f"spans {SPANS}"], ["held_out", "predicted"], _score(model, threshold))
    return got.withColumns({"held_out": held_out(F.col("doc_id"), modulus, remainder), "predicted": (F.col("score") >= threshold).cast("int")})
