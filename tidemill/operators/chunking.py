"""Overlapping chunks of texts, cut at paragraphs, then sentences, then words, then anywhere."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..config import Chunking

# Where a text may be cut.
PARAGRAPH, SENTENCE, WORD = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+")


def edges(text: str, limit: int) -> list[int]:
    """Places between units: 0, the end of each unit, the length of the text.

    Units are sentences within paragraphs, each with the space that follows it; a sentence beyond ``limit`` falls
    into words and a word beyond it into pieces of ``limit``.
    """

    def inner(pattern: re.Pattern, lo: int, hi: int) -> list[int]:
        return [lo, *(m.end() for m in pattern.finditer(text, lo, hi) if lo < m.end() < hi), hi]

    out = [0]
    for a, b in pairwise(inner(PARAGRAPH, 0, len(text))):
        for c, d in pairwise(inner(SENTENCE, a, b)):
            for e, f in pairwise(inner(WORD, c, d)) if d - c > limit else [(c, d)]:
                out += [*range(e + limit, f, limit), f]
    return out


def spans(text: str, rules: Chunking) -> list[tuple[int, int]]:
    """(start, end) of each chunk.

    A chunk takes units while they fit; the next begins at the last unit that leaves the wanted overlap, or one
    unit on where that would not advance.  A chunk below the minimum joins the one before it if both fit.
    """
    size, overlap = rules.chunk_size, rules.chunk_overlap
    if len(text) <= size:
        return [(0, len(text))] if text else []
    cuts = edges(text, size)
    last = len(cuts) - 1
    packed, i = [], 0
    while True:
        j = bisect_right(cuts, cuts[i] + size) - 1  # the chunk's end
        packed.append((cuts[i], cuts[j]))
        if j == last:
            break
        back = min(bisect_right(cuts, cuts[j] - overlap) - 1, j - 1)
        i = back if back > i else i + 1
    out = packed[:1]
    for a, b in packed[1:]:
        if b - a < rules.min_chunk_chars and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def page_of(char_start: Column, page_offsets: Column) -> Column:
    """The first page, from 1, that holds a place; null outside all pages."""
    numbered = F.transform(page_offsets, lambda p, i: F.when((p["start"] <= char_start) & (char_start < p["end"]), i + 1))
    return F.get(F.filter(numbered, lambda n: n.isNotNull()), F.lit(0))


_SPANS = ArrayType(StructType([StructField("char_start", IntegerType()), StructField("char_end", IntegerType())]))


def chunk(documents: DataFrame, rules: Chunking | None = None, text: str = "text") -> DataFrame:
    """One row for each chunk: the document's other columns, ord, char_start, char_end, page, text.

    ``documents`` may have page_offsets array<struct<start, end>>.  Null and empty texts give no chunk.  Only the
    spans come from Python; the text is cut in the JVM.
    """
    rules = rules or Chunking()

    @F.pandas_udf(_SPANS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"char_start": a, "char_end": b} for a, b in spans(t or "", rules)])

    paged = "page_offsets" in documents.columns
    keep = [c for c in documents.columns if c not in (text, "page_offsets")]
    rows = documents.select(*documents.columns, F.posexplode(cut(F.col(text))).alias("ord", "_span"))
    page = page_of(F.col("_span.char_start"), F.col("page_offsets")) if paged else F.lit(None)
    return rows.select(
        *keep,
        F.col("ord"),
        F.col("_span.char_start"),
        F.col("_span.char_end"),
        page.cast("int").alias("page"),
        F.substr(F.col(text), F.col("_span.char_start") + 1, F.col("_span.char_end") - F.col("_span.char_start")).alias("text"),
    )


def batched(df: DataFrame, group: list[str], order: list, size: int, name: str = "batch") -> DataFrame:
    """Number rows of each group into batches of ``size`` in that order."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn(name, F.floor(at / size).cast("int"))


