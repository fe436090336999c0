"""Reciprocal rank fusion, and the chunks that graph paths speak for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError


def fuse(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None, top_n: int | None = None, group: tuple[str, ...] = ("query_id",), key: str = "chunk_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (group, key, rank, carry...) of several ranked lists: score, best_rank, rank and the carried columns.

    A row gives weight / (k + rank) to its key, also where a list repeats a key.  Carried columns come from the
    first row of the best rank.  Order: score, then best rank, then key.
    """
    weights = weights if weights is not None else [1.0] * len(lists)
    if len(weights) != len(lists) or not lists:
        raise ValidationError("fusion needs one weight for each list")
    rows = [
        d.select(*group, key, "rank", *carry, F.lit(n).alias("_list"), F.lit(float(w)).alias("_w"))
        for n, (d, w) in enumerate(zip(lists, weights, strict=True))
    ]
    both = reduce(DataFrame.unionByName, rows)
    aggregates = [F.sum(F.col("_w") / (F.lit(k) + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank")]
    if carry:
        aggregates.append(F.min_by(F.struct(*carry), F.struct("rank", "_list")).alias("_row"))
    fused = both.groupBy(*group, key).agg(*aggregates)
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "best_rank", key)
    fused = fused.withColumn("rank", F.row_number().over(order))
    if top_n is not None:
        fused = fused.filter(F.col("rank") <= top_n)
    return fused.select(*group, key, "score", "best_rank", "rank", *[F.col(f"_row.{c}").alias(c) for c in carry])


def ranked(df: DataFrame, order: list, group: tuple[str, ...] = ("query_id",), top: int | None = None, name: str = "rank") -> DataFrame:
    """Number rows of each group from 1 in a total order, and keep the first ``top``."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return out if top is None else out.filter(F.col(name) <= top)


def chunks_of_paths(paths: DataFrame, group: tuple[str, ...] = ("query_id",), by_id: bool = True, ids: str = "chunk_ids", position: str | Column = "path_rank") -> DataFrame:
    """Graph paths as a ranked list of chunks: a chunk has the score of its best path.

    Ties rank by chunk id, or (``by_id`` false) by where the chunk was first seen.
    """
    seen = paths.select(*group, "score", F.expr(position).alias("_p") if isinstance(position, str) else position.alias("_p"), F.posexplode(ids).alias("_at", "chunk_id"))
    best = seen.groupBy(*group, "chunk_id").agg(F.max("score").alias("score"), F.min(F.struct("_p", "_at")).alias("_first"))
    order = [F.desc("score"), "chunk_id"] if by_id else [F.desc("score"), "_first", "chunk_id"]
    return ranked(best, order, group).select(*group, "chunk_id", "score", "rank")
