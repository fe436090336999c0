"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; 1- to 3-grams of code points are hashed into ``BUCKETS`` counts, weighted by inverse
document frequency and scaled to unit length.  Weights are trained by follow-the-regularised-leader (proximal,
one learning rate a coordinate) with elastic-net penalties on a bounded sample (whose document frequencies are
the fit's), then one temperature is fitted
on the part of that sample which training left out.

Edge cases: a null text or one without a letter is ``und`` with score 0; whole texts are used; with no usable
label at all everything is ``und``; repeated rows are each reported; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U
from .labelled import fitted, held_out, sample

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16 << 20
LETTER = re.compile(r"[^\W\d_]")
MULT = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))
PART = 1 << 20  # code points counted at a time


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(BUCKETS, dtype=np.int64)
    shift = U(64 - BUCKETS.bit_length() + 1)
    for a in range(0, max(len(code), 1), PART):
        x = code[a : a + PART + len(ORDERS) - 1].astype(np.uint64)
        for n in ORDERS:
            room = min(PART, len(x) - n + 1)
            if room > 0:
                h = x[:room] * MULT[0]
                for k in range(1, n):
                    h = h + x[k : k + room] * MULT[k]
                h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9 + 2 * n)
                out += np.bincount((h >> shift).view(np.int64), minlength=BUCKETS)
    return out


class Model:
    def __init__(self, classes: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.classes, self.idf, self.weights, self.bias, self.temperature = classes, idf, weights, bias, temperature

    def features(self, text: str) -> np.ndarray:
        x = counts(text) * self.idf
        norm = math.sqrt(float(x @ x))
        return (x / norm if norm else x).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not text or not LETTER.search(text):
            return "und", 0.0
        p = softmax((self.features(text) @ self.weights + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Sparse = tuple[np.ndarray, np.ndarray]  # feature numbers and values of one text


def ftrl(x: list[Sparse], y: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on sparse rows; the feature after the last is the bias, which l1 spares."""
    rng = np.random.default_rng(seed)
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(rows: np.ndarray) -> np.ndarray:
        zr, nr = z[rows], n[rows]
        one = np.where((rows == BUCKETS)[:, None], 0.0, l1)
        return np.where(np.abs(zr) <= one, 0.0, -(zr - np.sign(zr) * one) / ((beta + np.sqrt(nr)) / alpha + l2))

    target = np.eye(classes)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            rows, v = np.append(x[i][0], BUCKETS), np.append(x[i][1], 1.0)
            w = weights(rows)
            g = v[:, None] * (softmax(v @ w) - target[y[i]])[None, :]
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(softmax(logits / math.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, ratio = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(rows: list[tuple[str, object]]) -> Model:
    rows = [(t, str(y)) for t, y in rows if t and LETTER.search(t)]
    classes = sorted({y for _, y in rows})
    if not classes:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    x = []
    df = np.zeros(BUCKETS)
    for t, _ in rows:
        c = counts(t)
        held = np.flatnonzero(c)
        df[held] += 1
        x.append((held, c[held].astype(np.float32)))
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    for i, (held, c) in enumerate(x):
        v = c * idf[held]
        x[i] = held, (v / np.sqrt(v @ v)).astype(np.float32)
    y = np.array([classes.index(c) for _, c in rows])
    last = np.arange(len(rows)) % 8 == 7
    train, rest = [i for i in range(len(rows)) if not last[i]], [i for i in range(len(rows)) if last[i]]
    weights, bias = ftrl([x[i] for i in train], y[train], len(classes))
    temperature = temperature_of(np.array([x[i][1] @ weights[x[i][0]] + bias for i in rest]), y[rest]) if len(rest) >= 8 else 1.0
    return Model(classes, idf, weights, bias, temperature)


def _predict(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                got = [model.predict(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=schema)

    return run


def identify_language(documents: DataFrame, modulus: int = 4, remainder: int = 2, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``documents`` (doc_id, text, lang): held_out, lang_pred and score of each row.

    The fit sees only rows with a label whose crc32(doc_id) mod ``modulus`` is not ``remainder``, at most
    ``sample_rows`` of them and ``sample_bytes``.
    """
    model = fitted(sample(documents, None, "lang", ~held_out(F.col("doc_id"), modulus, remainder), sample_rows, sample_bytes), fit)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = docs.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return got.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score")
