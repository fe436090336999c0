"""Similarity of vectors and of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import Resolution


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two arrays, 0 where either has no length; arrays of different sizes raise."""
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast("double")).when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def jaro_winkler_of(a: str | None, b: str | None, prefix_weight: float = 0.1) -> float:
    """Jaro-Winkler similarity; the prefix counts above a Jaro similarity of 0.7, as its author has it.  A null is like nothing."""
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), -1)
        if j >= 0:
            free[j] = False
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    n = len(left)
    jaro = (n / len(a) + n / len(b) + (n - swaps) / n) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * prefix_weight * (1 - jaro)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one bit vector of machine integers."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = 0
    for c in b:
        x = row | where.get(c, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def token_set_of(a: str | None, b: str | None) -> float:
    """The best of three comparisons between shared tokens and what each name adds to them, from 0 to 1; 0 for a null."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    only_a, only_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not only_a or not only_b):
        return 1.0
    gap = bool(shared)
    long_a, long_b = len(shared) + gap + len(only_a), len(shared) + gap + len(only_b)
    change = len(only_a) + len(only_b) - 2 * common_subsequence(only_a, only_b)
    best = 1 - change / (long_a + long_b)
    if shared:
        best = max(best, *(1 - (gap + len(o)) / (len(shared) + n) for o, n in ((only_a, long_a), (only_b, long_b))))
    return best


def _each_pair_once(score):
    """A pandas UDF that scores each distinct pair of a batch once."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = score(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run


jaro_winkler = _each_pair_once(jaro_winkler_of)
token_set_ratio = _each_pair_once(token_set_of)


def score_pair(a_name: Column, b_name: Column, a_type: Column, b_type: Column, cosine_ab: Column, rules: Resolution) -> Column:
    mix = rules.weight_jaro_winkler * jaro_winkler(a_name, b_name) + rules.weight_token_set * token_set_ratio(a_name, b_name) + rules.weight_cosine * cosine_ab
    mix = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mix))
    return F.when(a_type == b_type, mix).otherwise(0.0) if rules.require_type_match else mix


def band(score: Column, rules: Resolution) -> Column:
    return F.when(score >= rules.merge_at, "merge").when(score <= rules.reject_at, "reject").otherwise("gray")
