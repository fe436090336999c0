"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks, and every block is compressed once with each dictionary.  The sizes summed over the
whole text give the difference (good - bad) / length, negative where the good dictionary knows the text better.  It is the
only input of the score: an isotonic calibration, which can only fall as the difference grows, turns it into the
chance of label 1.

Edge cases: null and empty texts have a difference of 0 and get the calibrated score of that; with one class
or none among the labels the score is the share of label 1 (0.5 without labels); whole texts are used;
repeated rows are each reported; other columns are kept.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fitted, held_out, sample, scored

#: Bytes of a block to compress, of a piece to train on, and of a dictionary.
STEP, BLOCK, LEVEL, DICTIONARY = 512, 2048, 3, 256 << 10
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 32 << 20
#: Bytes of a class that its dictionary is trained on.
DICTIONARY_BYTES = 25 * DICTIONARY


class Model:
    """Two dictionaries and a calibration curve; compressors are made where the model is used."""

    def __init__(self, good: bytes, bad: bytes, differences: np.ndarray, chances: np.ndarray):
        self.good, self.bad, self.differences, self.chances = good, bad, differences, chances
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        """Bytes of the text, and of it compressed with the good and with the bad dictionary."""
        if self._pair is None:
            self._pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=ready(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]
        raw = (text or "").encode("utf-8", "surrogatepass")
        good = bad = 0
        for a in range(0, len(raw), STEP):
            piece = raw[a : a + STEP]
            good += len(self._pair[0].compress(piece))
            bad += len(self._pair[1].compress(piece))
        return len(raw), good, bad

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        return np.interp(difference(sizes), self.differences, self.chances)


def ready(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return d


def difference(sizes: np.ndarray) -> np.ndarray:
    """Compressed bytes that the bad dictionary saves a byte of text; 0 for an empty text."""
    n, good, bad = sizes.reshape(-1, 3).T.astype(np.float64)
    return (good - bad) / np.maximum(n, 1)


def falling(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curve of least squares that never rises with ``x``, by pooling adjacent violators: its corners.

    A pool's chance is drawn half a case towards a half, so that none is certain.
    """
    places, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []  # ones, cases, first and last place
    for place, ones, cases in zip(places.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist(), strict=True):
        pools.append([ones, cases, place, place])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] <= pools[-1][0] * pools[-2][1]:
            ones, cases, _, last = pools.pop()
            pools[-1][0] += ones
            pools[-1][1] += cases
            pools[-1][3] = last
    corners = [(place, (ones + 0.5) / (cases + 1)) for ones, cases, first, last in pools for place in sorted({first, last})]
    places, chances = np.array(corners).T
    return places, np.minimum.accumulate(chances)


def dictionary_of(texts: list[str], max_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of a class; where there is too little to train on, its raw text.

    It is trained on at most ``max_bytes`` of pieces, dealt from all texts in turn: one piece of each, then a second
    of each that has more, and so on, a text's pieces in a fixed random order.
    """
    rng = random.Random(7)
    dealt: list[tuple[int, int, int]] = []  # turn, text, first byte
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    for n, raw in enumerate(raws):
        begins = list(range(0, len(raw), BLOCK))
        rng.shuffle(begins)
        dealt += [(turn, n, a) for turn, a in enumerate(begins)]
    total = 0
    kept = []
    for _, n, a in sorted(dealt):
        piece = raws[n][a : a + BLOCK]
        if total + len(piece) > max_bytes:
            break
        kept.append(piece)
        total += len(piece)
    try:
        return zstandard.train_dictionary(DICTIONARY, kept).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(kept)[-DICTIONARY:] or b" " * 16


def fit(rows: list[tuple[str, object]], dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Dictionaries from two thirds of the rows, calibration on the rest."""
    y = np.array([int(v) for _, v in rows], dtype=np.float64)
    third = np.arange(len(rows)) % 3 == 2
    groups = [[t for (t, v), c in zip(rows, third, strict=True) if int(v) == k and not c and t] for k in (1, 0)]
    if not all(groups) or len(set(y[third])) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Model(b" " * 16, b" " * 16, np.zeros(1), np.array([share]))
    model = Model(dictionary_of(groups[0], dictionary_bytes), dictionary_of(groups[1], dictionary_bytes), np.zeros(1), np.zeros(1))
    sizes = np.array([model.sizes(t) for (t, _), c in zip(rows, third, strict=True) if c])
    model.differences, model.chances = falling(difference(sizes), y[third])
    return model


def _score(model: Model):
    added = [pa.field("score", pa.float64()), pa.field("good_bytes", pa.int64()), pa.field("bad_bytes", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*list(batch.schema)[1:], *added])
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sizes = np.array([model.sizes(t.as_py()) for t in part.column(0)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(model.scores(sizes)), pa.array(sizes[:, 1].copy()), pa.array(sizes[:, 2].copy())], schema=schema)

    return run


def score_quality(documents: DataFrame, training: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """``documents`` (doc_id, text, ...): its columns with held_out, score, predicted, good_bytes and bad_bytes.

    The fit joins ``training`` (doc_id, text) with ``labels`` (doc_id, quality) where crc32(doc_id) mod ``modulus``
    is not ``remainder``, and takes at most ``sample_rows`` rows and ``sample_bytes``; each class's dictionary is trained on at
    most ``dictionary_bytes`` of them, in pieces from all rows of the class in turn.  Columns of ``documents`` with
    one of the added names are replaced.
    """
    model = fitted(sample(training, labels, "quality", ~held_out(F.col("doc_id"), modulus, remainder), sample_rows, sample_bytes), partial(fit, dictionary_bytes=dictionary_bytes))
    got = scored(documents, ["score double", "good_bytes long", "bad_bytes long"], ["held_out", "predicted"], _score(model))
    return got.withColumns({"held_out": held_out(F.col("doc_id"), modulus, remainder), "predicted": (F.col("score") >= threshold).cast("int")})
