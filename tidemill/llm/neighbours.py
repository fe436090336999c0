"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks.  A tile of query block by candidate block is the product of int8 matrices; with
each vector's own scale and the exact norm of its rounding error, that product bounds every distance from both
sides.  A candidate survives for a query unless its lower bound exceeds the k-th smallest upper bound of distinct
ids seen so far.  Survivors are computed again from the original vectors in double precision and merged into the query's
heap of k.  Nothing is approximate in the result: the bounds only spare work.

Queries are a stated set.  Their blocks are sent to the candidates in waves of bounded bytes, so neither side is ever
shuffled whole and no pair of rows is emitted but each task's k best of each query.  Where it takes several waves, the
candidates are packed once into a shared table, and each wave is a job of its own that stores its queries' results.

Edge cases: vectors that are null, zero, or hold null, NaN or infinite components take no part on either side;
vectors of other dimensions than the query's are no candidates; ties go to the smaller vec_id; rows that repeat
a vec_id count once as candidates, at their nearest, and once as queries, by their least vector that takes part; fewer than k candidates are all given;
a distance whose square is beyond the largest double is infinite, and ties with others that are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize, new_path

#: Vectors of a block, and the bytes that a block holds at most if it holds several vectors.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
WAVE_BYTES = 16 << 20
PACKED = "dim int, ids binary, vectors binary"


def rows_of(dim: int, block: int, block_bytes: int) -> int:
    """Vectors of a block of that dimension."""
    return max(1, min(block, block_bytes // (8 * max(dim, 1))))


def _pack(block: int, block_bytes: int):
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(rows).tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                rows = flat[begin[at][:, None] + np.arange(dim)]
                good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
                at, rows = at[good], rows[good]
                step = rows_of(dim, block, block_bytes)
                for a in range(0, len(at), step):
                    x, y = held.setdefault(dim, ([], []))
                    x.append(ids[at][a : a + step])
                    y.append(rows[a : a + step])
                    if sum(map(len, x)) >= step:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


class Block:
    """Vectors with their int8 form: x = scale * code + error, with the error's norm known."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.x = np.frombuffer(vectors, dtype=np.float64).reshape(-1, dim)
        self.scale = np.abs(self.x).max(axis=1) / 127
        self.code = np.rint(self.x / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        with np.errstate(over="ignore"):
            self.error = np.sqrt(((self.x - near) ** 2).sum(axis=1))
            self.square = (near**2).sum(axis=1)
        self.norm = np.sqrt(self.square)
        self.by_id = np.argsort(self.ids, kind="stable")
        ordered = self.ids[self.by_id]
        self.first_of_id = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))

    def least_of_id(self, values: np.ndarray) -> np.ndarray:
        """Columns, one for each row of this block, reduced to the least of each distinct id."""
        if len(self.first_of_id) == len(self.ids):
            return values
        return np.minimum.reduceat(values[:, self.by_id], self.first_of_id, axis=1)


def tile(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the int8 forms, and how far the true distances may be from them."""
    dot = np.zeros((len(q.ids), len(c.ids)))
    for a in range(0, q.x.shape[1], 1024):  # sums of 1024 products of int8 are exact in a float
        dot += q.code[:, a : a + 1024].astype(np.float32) @ c.code[:, a : a + 1024].astype(np.float32).T
    square = q.square[:, None] + c.square[None, :] - 2 * q.scale[:, None] * c.scale[None, :] * dot
    slack = q.error[:, None] + c.error[None, :] + 1e-7 * (q.norm[:, None] + c.norm[None, :])
    return np.sqrt(np.maximum(square, 0)), slack


class Heaps:
    """The k nearest so far of each query of one block, by (distance, id)."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.distance = np.full((len(block.ids), k), np.inf)
        self.id = np.full((len(block.ids), k), np.iinfo(np.int64).max)

    def offer(self, c: Block) -> None:
        q, k = self.block, self.k
        with np.errstate(over="ignore", invalid="ignore"):
            near, slack = tile(q, c)
            least, most = near - slack, near + slack
        # squares beyond the largest number bound nothing: such pairs are compared exactly
        least[np.isnan(least)], most[np.isnan(most)] = -np.inf, np.inf
        own = q.ids[:, None] == c.ids[None, :]
        # rows that repeat an id offer one neighbour, so the bound counts distinct ids
        upper = c.least_of_id(np.where(own, np.inf, most))
        bound = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(q.ids), np.inf)
        bound = np.minimum(bound, self.distance[:, -1])
        i, j = np.nonzero((least <= bound[:, None]) & ~own)
        for a in range(0, len(i), 100_000):
            self._merge(i[a : a + 100_000], j[a : a + 100_000], c)

    def _merge(self, i: np.ndarray, j: np.ndarray, c: Block) -> None:
        with np.errstate(over="ignore"):
            exact = np.sqrt(((self.block.x[i] - c.x[j]) ** 2).sum(axis=1))  # infinite where its square is beyond the largest number
        rows = np.unique(i)
        owner = np.concatenate([i, np.repeat(rows, self.k)])
        distance = np.concatenate([exact, self.distance[rows].ravel()])
        ids = np.concatenate([c.ids[j], self.id[rows].ravel()])
        order = np.lexsort((ids, distance, owner))
        owner, distance, ids = owner[order], distance[order], ids[order]
        # a vector stands once for a query, at its nearest
        seen = np.lexsort((np.arange(len(ids)), ids, owner))
        again = np.zeros(len(ids), dtype=bool)
        again[seen[1:]] = (ids[seen][1:] == ids[seen][:-1]) & (owner[seen][1:] == owner[seen][:-1]) & (ids[seen][1:] != np.iinfo(np.int64).max)
        owner, distance, ids = owner[~again], distance[~again], ids[~again]
        start = np.searchsorted(owner, rows)
        nth = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
        keep = nth < self.k
        self.distance[owner[keep], nth[keep]] = distance[keep]
        self.id[owner[keep], nth[keep]] = ids[keep]


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[bytes, Heaps] = {}
        for batch in batches:
            for dim, qi, qv, ci, cv in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
                heap = heaps.get(qi)
                if heap is None:
                    heap = heaps[qi] = Heaps(Block(dim, qi, qv), k)
                heap.offer(Block(dim, ci, cv))
        for heap in heaps.values():
            found = heap.id != np.iinfo(np.int64).max
            i, _ = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(heap.block.ids[i]), pa.array(heap.id[found]), pa.array(heap.distance[found])], schema=schema)

    return run


def usable(embedding: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, wave_bytes: int = WAVE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``vectors`` (vec_id, embedding): query_id, rank, vec_id and score of each query's ``k`` nearest.

    ``is_query`` marks the queries among the rows; each is searched among all rows but its own.
    """
    spark = vectors.sparkSession

    def part(rows: DataFrame) -> DataFrame:
        own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return own.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))

    # candidates are sifted where they are packed
    queries = part(vectors.filter(is_query)).filter(usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    dim = shape["dim"] or 1
    rows = rows_of(dim, block, block_bytes)
    blocks = max(1, -(-shape["n"] // rows))
    in_wave = max(1, wave_bytes // (rows * dim * 8 * 2))
    waves = range(0, blocks, in_wave)
    pack = _pack(block, block_bytes)
    queries = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    candidates = part(vectors).mapInArrow(pack, PACKED).withColumnsRenamed({"ids": "c_ids", "vectors": "c_vectors"})
    if len(waves) > 1:
        queries, candidates = materialize(queries, "queries"), materialize(candidates, "candidates")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def found(first: int) -> DataFrame:
        own = queries.filter((F.col("q") >= first) & (F.col("q") < first + in_wave))
        # about a block's vectors meet in a task, hence in a packed row
        own = own.repartition(min(in_wave, blocks - first), "q").select("vec_id", "embedding").mapInArrow(pack, PACKED)
        tiles = candidates.join(F.broadcast(own), "dim").select("dim", "ids", "vectors", "c_ids", "c_vectors")
        best = tiles.mapInArrow(_search(k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if len(waves) == 1:
        return found(0)
    path = new_path(spark, "neighbours")
    for n, first in enumerate(waves):
        found(first).write.parquet(f"{path}/wave={n}")
    discard(candidates)
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(path).select("query_id", "rank", "vec_id", "score")
