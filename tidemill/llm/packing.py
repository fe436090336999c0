"""Best-fit packing by large-item matching.

Every piece longer than a third of a sequence fits with at most one other such piece.  Large pieces are matched
greedily, the longest with the longest that still fits; smaller ones then go, longest first, where they leave
the smallest gap.  Only lengths matter to that, and there are at most ``capacity`` of them: the driver packs the
histogram of lengths and gets a plan of ranges, (length, ranks from lo to hi) -> sequences, whose size depends on
the capacity and not on the data.  Pieces then find their place by their rank within their length, which is
counted in salted parts so that a length held by many pieces is not counted in one task.

Edge cases: null and empty texts are one piece of the end token alone; repeated rows are pieces of their own;
only texts longer than a sequence are cut, and only the first of their pieces may be shorter; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import chunks
from .storage import materialize
from .tokens import PLAIN_BYTE, byte_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, lo long, hi long, sequence long, offset long, per long"


def _pieces(path: str, ranks: str | None, pattern: str | None, end: int, capacity: int):
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(path, ranks, pattern)
        tail = np.array([end], dtype="<u4")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in chunks(batch.column(1)):
                rows = []
                raw = data.tobytes()
                for r in range(lo, hi):
                    a, b = int(offsets[r - lo]), int(offsets[r - lo + 1])
                    plain = b == a or int(data[a:b].max()) <= PLAIN_BYTE
                    tokens = np.concatenate([model.ids(raw[a:b].decode("utf-8"), plain).astype("<u4"), tail])
                    n = len(tokens)
                    cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((ids[r], k, s, e - s, zlib.crc32(tokens[s:e].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return run


def plan_of(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack a histogram of lengths: rows (length, lo, hi, sequence, offset, per).

    Pieces of ``length`` with a rank in [lo, hi) go, ``per`` to each, into consecutive sequences from
    ``sequence``, one after the other from ``offset``.
    """
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # gap -> runs of (sequence, how many)
    plan, opened = [], 0

    def place(length: int, n: int, sequence: int, offset: int, per: int) -> None:
        plan.append((length, used[length], used[length] + n, sequence, offset, per))
        used[length] += n
        left[length] -= n

    large = capacity // 3
    for length in sorted((k for k in left if k > large), reverse=True):
        while left[length]:
            mate = next((m for m in range(min(length, capacity - length), large, -1) if left.get(m, 0) > (m == length)), None)
            n = left[length] if mate is None else left[length] // 2 if mate == length else min(left[length], left[mate])
            place(length, n, opened, 0, 1)
            if mate is not None:
                place(mate, n, opened, length, 1)
            gaps[capacity - length - (mate or 0)].append((opened, n))
            opened += n
    for length in sorted((k for k in left if k <= large), reverse=True):
        while left[length]:
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
            if gap is None:
                n = -(-left[length] // (capacity // length))
                gaps[capacity].append((opened, n))
                opened += n
                continue
            sequence, n = gaps[gap].pop()
            per = min(gap // length, left[length])
            bins = min(n, left[length] // per)
            if bins < n:
                gaps[gap].append((sequence + bins, n - bins))
            place(length, bins * per, sequence, capacity - gap, per)
            gaps[gap - per * length].append((sequence, bins))
    return plan


def pack(documents: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end: int = 2, capacity: int = 1024, salts: int = 256) -> DataFrame:
    """``documents`` (doc_id, text): each piece's place, as doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is a byte-level BPE file for tokenizers; ``ranks`` and ``pattern`` optionally name the same
    vocabulary for the faster library (see ``tokens.ByteBpe``).  ``end`` closes every document.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(docs.mapInArrow(_pieces(tokenizer, ranks, pattern, end, capacity), PIECES), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_of(counts, capacity), PLAN)
    salts = max(salts, sum(counts.values()) // 20_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    at = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("offset") + F.pmod(at, F.col("per")) * ranked["length"]).cast("long").alias("offset"),
    )
