"""Dense, sparse and hybrid top-k search over chunks, for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..errors import ValidationError
from ..functions.similarity import cosine, norm
from ..functions.text import tokens
from ..session import small_batches
from ..shared import materialize
from . import postings
from .fusion import fuse, ranked
from .knn import nearest
from .numbering import positions
from .tables import payload_filter

#: A query side is broadcast only up to this many rows; larger batches are searched in slices of it.
QUERY_ROWS = 20_000
#: Bytes of text whose terms are counted in a task.
TEXT_BYTES = 8 << 20
#: Bytes of a wave of query vectors that is sent to the points, and of a block of it.
QUERY_BYTES = 16 << 20
BLOCK_BYTES = 2 << 20
#: Pairs whose nearness is computed at once in a task, and picked pairs that are scored again at once.
PAIRS, PICKED = 1 << 19, 1 << 14


def query_slices(queries: DataFrame, rows: int = QUERY_ROWS) -> list[DataFrame]:
    """Parts of a query table, each of about ``rows`` rows at most, cut by the query id's hash."""
    n = queries.count()
    parts = max(1, -(-n * 5 // (rows * 4)))
    return [queries] if parts == 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) for p in range(parts)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, vector) of a batch as one row of lists."""
    for batch in batches:
        if batch.num_rows:
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), c) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(lists, names=["keys", "vectors"])


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = width if width is not None else len(flat) // max(1, len(lists))
    if (lists.value_lengths().to_numpy() != width).any():
        raise ValueError("vectors differ in size")
    return flat.reshape(len(lists), width)


def _best(found: pa.Table, k: int) -> pa.Table:
    """The first k rows (query, score, key) of each query."""
    found = found.sort_by([("query", "ascending"), ("score", "descending"), ("key", "ascending")])
    query = found["query"].to_numpy()
    return found.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))


def _cosines(dots: np.ndarray, a: np.ndarray, b: np.ndarray, empty: float) -> np.ndarray:
    """Cosines of dot products and squared norms; ``empty`` where either is 0.  Where their product leaves the range of doubles, by two roots."""
    with np.errstate(over="ignore", under="ignore"):
        product = a * b
    plain = (product > 1e-290) & (product < np.inf)
    scale = np.where(plain, np.sqrt(product), np.sqrt(a) * np.sqrt(b))
    return np.where(scale > 0, np.clip(np.divide(dots, scale, out=np.zeros(len(dots)), where=scale > 0), -1.0, 1.0), empty)


def _block_top_k(k: int, query: pa.DataType, key: pa.DataType, empty: float = 0.0):
    """Blocks of points met by blocks of queries (block, queries, keys, vectors): each query's k most similar points of the task.

    A matrix product finds who can be among them; their scores are computed again pair by pair, so that equal vectors have
    equal scores wherever they stand, and ties go to the smaller key.  A score is the dot product over one root of the product of the
    squared norms, from -1 to 1: counted letters, whose sums are exact, have the very doubles of SQL, so that vectors of one direction
    rank as SQL ranks them.
    """
    schema = pa.schema([("query_id", query), ("key", key), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[pa.Array, np.ndarray, np.ndarray]] = {}  # query ids, vectors and squared norms of a block
        best: dict[int, pa.Table] = {}
        for batch in batches:
            for block, queries, keys, vectors in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                if block not in held:
                    matrix = _matrix(queries.values.field("vector")).copy()  # a view would keep the whole batch, points and all
                    held[block] = queries.values.field("query_id").take(pa.array(np.arange(len(matrix)))), matrix, (matrix * matrix).sum(axis=1)
                _, matrix, squares = held[block]
                points = _matrix(vectors.values, matrix.shape[1])
                norms = (points * points).sum(axis=1)
                parts = [best[block]] if block in best else []
                step = max(1, min(256, PAIRS // len(points)))
                for a in range(0, len(matrix), step):
                    part, own = matrix[a : a + step], squares[a : a + step]
                    near, scale = part @ points.T, np.sqrt(own)[:, None] * np.sqrt(norms)[None, :]
                    near[~(scale > 0)] = empty
                    np.divide(near, scale, out=near, where=scale > 0)
                    del scale
                    at = max(near.shape[1] - k, 0)
                    i, j = np.nonzero(near >= np.partition(near, at, axis=1)[:, at, None] - 1e-9)
                    del near
                    exact = np.zeros(len(i))
                    for c in range(0, len(i), PICKED):
                        x, y = i[c : c + PICKED], j[c : c + PICKED]
                        exact[c : c + PICKED] = _cosines((part[x] * points[y]).sum(axis=1), own[x], norms[y], empty)
                    parts.append(_best(pa.table({"query": pa.array(a + i, pa.int64()), "score": exact, "key": keys.values.take(pa.array(j))}), k))
                best[block] = _best(pa.concat_tables(parts), k)
        for block, rows in best.items():
            for part in rows.combine_chunks().to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([held[block][0].take(part.column(0)), part.column(2), part.column(1)], schema=schema)

    return run


def dense_top_k(queries: DataFrame, points: DataFrame, k: int, filters: dict | None = None, group_filter: Column | None = None, key: str = "chunk_id", vector: str = "dense", min_score: float | None = None, same: str | None = None, empty: float = 0.0) -> DataFrame:
    """``queries`` (query_id, vector) against ``points``: query_id, key, score, rank of the k most similar.

    Filters hold before ranking, ``min_score`` after it.  Points are packed into blocks where they lie and never shuffled; blocks of
    queries go to them, a bounded wave at a time and each wave as a job, and a task sends k points of a query at most.  No query comes
    to the driver but in a wave that Spark broadcasts.  Points without a vector are not found.  ``same`` names a column in which query
    and point must agree.  ``group_filter`` may compare any ``q_`` columns of the query with columns of the point; its work is that of
    all pairs that it lets through.  Without both, ``empty`` is the score of pairs of which one has no length.
    """
    points = payload_filter(points, filters or {})
    small_batches(points.sparkSession)
    found = None
    if same is not None:
        place = (lambda d: d.withColumn("place", F.col(key))) if dict(points.dtypes)[key] in ("bigint", "int") else (lambda d: positions(d, [key], name="place"))
        theirs = place(points.select(F.col(key), F.col(same).cast("string").alias("kind"), F.col(vector).alias("vector"))).withColumn("gid", F.col(key))
        ours = queries.select(F.col("query_id").alias("gid"), F.col(same).cast("string").alias("kind"), F.lit(0).alias("place"), "vector")
        near = nearest(ours, theirs, k).select(F.col("gid").alias("query_id"), F.col("c_gid").alias(key), F.col("cosine").alias("score"))
        found = ranked(near, [F.desc("score"), key], top=k)
    elif group_filter is None:
        sized = queries.filter(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        shape = sized.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("most"), F.min(F.size("vector")).alias("least")).first()
        if shape["most"] != shape["least"]:
            raise ValidationError("vectors differ in size")
        types = points.schema[key].dataType, queries.schema["query_id"].dataType
        out = StructType([StructField("query_id", types[1]), StructField("key", types[0]), StructField("score", DoubleType())])
        blocks = max(1, -(-shape["n"] * 8 * (shape["most"] or 1) // BLOCK_BYTES))
        waves = -(-blocks // (QUERY_BYTES // BLOCK_BYTES))
        packed = points.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("vector"))
        packed = packed.mapInArrow(_packed, StructType([StructField("keys", ArrayType(types[0])), StructField("vectors", ArrayType(ArrayType(DoubleType())))]))
        rows = sized.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        if waves > 1:
            packed, rows = materialize(packed, "points"), materialize(rows, "queries")
        for wave in range(waves):
            part = rows.filter(F.col("block") % waves == wave).groupBy("block").agg(F.collect_list(F.struct("query_id", "vector")).alias("queries"))
            met = packed.crossJoin(F.broadcast(part)).select("block", "queries", "keys", "vectors")
            got = ranked(met.mapInArrow(_block_top_k(k, to_arrow_type(types[1]), to_arrow_type(types[0]), empty), out).withColumnRenamed("key", key), [F.desc("score"), key], top=k)
            got = materialize(got, "wave") if waves > 1 else got
            found = got if found is None else found.unionByName(got)
    else:
        points = points.filter(F.col(vector).isNotNull()).withColumn("_n", norm(F.col(vector)))
        for part in query_slices(queries):
            q = part.select(*[F.col(c).alias(c if c == "query_id" else f"q_{c}") for c in part.columns]).withColumn("_qn", norm(F.col("q_vector")))
            pairs = points.join(F.broadcast(q), group_filter)
            score = cosine(F.col("q_vector"), F.col(vector), F.col("_qn"), F.col("_n"))
            got = ranked(pairs.select("query_id", key, score.alias("score")), [F.desc("score"), key], top=k)
            found = got if found is None else found.unionByName(got)
    return found if min_score is None else found.filter(F.col("score") >= min_score)


def term_frequencies(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, term, tf): the sparse form of texts.  A text without terms has no row, which every join allows.

    Texts are dealt by key before they are cut, so the much longer list of their terms is counted where it arises, and
    whatever groups by key later finds its rows together.  They are measured first: a partition has about ``TEXT_BYTES`` of
    text, however many there are, so the counts of a task do not grow with the table.
    """
    size = chunks.agg(F.sum(F.octet_length(text))).first()[0] or 0
    dealt = chunks.select(key, text).repartition(max(1, -(-size // TEXT_BYTES)), F.col(key))
    return dealt.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("tf"))


def sparse_vectors(terms: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, indices, values): hashed terms, the values of equal indices summed, indices ascending."""
    hashed = terms.select(key, F.abs(F.hash("term")).alias("index"), "tf").groupBy(key, "index").agg(F.sum("tf").alias("value"))
    pairs = hashed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("_p"))
    return pairs.select(key, F.transform("_p", lambda p: p["index"]).alias("indices"), F.transform("_p", lambda p: p["value"]).alias("values"))


def inverse_frequencies(terms: DataFrame, n_chunks: DataFrame | int) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (N - df + 0.5) / (df + 0.5)) over all chunks.

    ``terms`` has one row for each key and term, as ``term_frequencies`` gives them.
    """
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(n_chunks) if isinstance(n_chunks, int) else F.col("n")
    df = df if isinstance(n_chunks, int) else df.join(F.broadcast(n_chunks.select(F.count("*").alias("n"))))
    return df.select("term", "df", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def sparse_top_k(query_terms: DataFrame, terms: DataFrame, idf: DataFrame, k: int, allowed: DataFrame | None = None, key: str = "chunk_id", index: DataFrame | None = None) -> DataFrame:
    """``query_terms`` (query_id, term, tf) against ``terms`` (key, term, tf): sum of q.tf * d.tf * idf.

    A query without known terms has an empty list.  ``allowed`` keeps chunks before ranking.  Scores are rounded to
    nine digits, so that equal texts tie in whatever order their terms are added.  Terms are indexed once for all queries, or an
    ``index`` is given for them (see ``postings``); what cannot be among the best is skipped.
    """
    weighted = query_terms.join(idf.select("term", "idf"), "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    return postings.top_k(weighted, postings.build(terms, key) if index is None else index, k, key, allowed)


def hybrid_search(dense_queries: DataFrame, query_terms: DataFrame, points: DataFrame, terms: DataFrame, idf: DataFrame, top_k: int = 20, prefetch: int = 50, rrf_k: int = 60, weights: dict[str, float] | None = None, filters: dict | None = None, key: str = "chunk_id", index: DataFrame | None = None, empty: float = 0.0) -> DataFrame:
    """Both branches under the same filters, fused by rank: query_id, key, score, best_rank, rank."""
    weights = weights or {}
    if set(weights) - {"dense", "sparse"}:
        raise ValidationError(f"unknown branches: {sorted(set(weights) - {'dense', 'sparse'})}")
    dense = dense_top_k(dense_queries, points, prefetch, filters, key=key, empty=empty)
    allowed = payload_filter(points, filters).select(key) if filters else None
    sparse = sparse_top_k(query_terms, terms, idf, prefetch, allowed, key, index)
    return fuse([dense, sparse], rrf_k, [weights.get("dense", 1.0), weights.get("sparse", 1.0)], top_k, key=key)
