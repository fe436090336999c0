"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Words, shingles and their hashes are computed for many documents at once from one byte buffer, with no
Python object for a word.  A word's hash is a random-table polynomial over its bytes, taken from prefix
sums modulo 2**64, so it needs one multiplication whatever the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SHINGLE_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of about ``limit`` bytes: (first row, end row, bytes, row offsets).

    Nulls count as empty.  A longer text is a run of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes, no run crossing a row's edge."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][(offsets[:-1] < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Hashed words of a run of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None, prefix: int = 0):
        low = LOWER[data]
        self.starts, self.ends = spans(~SPACE[low] if is_word is None else is_word[low], offsets)
        power, inverse = powers(len(low) + 1)
        sums = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[low] * power[:-1], dtype=np.uint64, out=sums[1:])
        back = inverse[self.starts]
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * back)
        if prefix:
            cut = np.minimum(self.ends, self.starts + prefix)
            self.prefixes = mix((sums[cut] - sums[self.starts]) * back + U(77))
        #: word number where each document begins, and one past the last
        self.bounds = np.searchsorted(self.starts, offsets, side="left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each document's set of word shingles as a sorted array of 64-bit hashes.

    A document of fewer than ``width`` words, but not none, has its whole sequence as its one shingle.
    """
    words = Words(data, offsets)
    h = words.hashes
    count = max(0, len(h) - width + 1)
    rolled = np.zeros(count, dtype=np.uint64)
    for j in range(width):
        rolled += h[j : j + count] * SHINGLE_MULT[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                whole = (h[a:b] * SHINGLE_MULT[: b - a]).sum(dtype=np.uint64) + U(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
