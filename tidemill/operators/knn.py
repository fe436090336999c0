"""The most similar earlier or other rows of each row, by blocks of vectors: in full, or through an inverted file.

An inverted file deals vectors to the nearest of some centroids, which are fitted on a bounded sample; a row then meets the lists of its
``probes`` nearest centroids only.  Lists are cut into blocks of bounded size, so that a list may hold any share of the rows, and blocks
meet by a join; a matrix product picks who can be among the nearest, and picked pairs are scored again one by one, so that equal vectors
score alike wherever they stand.  Without an inverted file there is one list.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import small_batches
from .fusion import ranked

#: Rows on which centroids are fitted, at most.
SAMPLE = 8192
#: Rows of a list, on average, until there are LISTS lists.
LIST_ROWS = 512
LISTS = 1024
#: Rows of a block.
BLOCK = 512
#: Lists that a row meets.
PROBES = 24


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if not len(lists):
        return flat.reshape(0, 0)
    if len(flat) % len(lists) or (lists.value_lengths().to_numpy() != len(flat) // len(lists)).any():
        raise ValueError("vectors differ in size")
    return flat.reshape(len(lists), -1)


def centroids(points: DataFrame, key: str = "gid", vector: str = "vector", list_rows: int = LIST_ROWS, rounds: int = 8) -> np.ndarray | None:
    """Unit centroids of about one list for ``list_rows`` rows, by spherical k-means in one task over at most SAMPLE rows drawn by hash.

    None where one list is enough: every row then meets every other.
    """
    n = points.count()
    lists = min(LISTS, n // list_rows)
    if lists < 2:
        return None
    keys = points.filter(F.col(vector).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(SAMPLE)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_matrix(b.column(0)) for b in batches if b.num_rows]
        rows = _unit(np.concatenate(held)) if held else np.zeros((0, 1))
        rows = rows[np.lexsort(rows.T)]  # the same start wherever the rows came from
        now = rows[np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int)] if len(rows) else rows
        for _ in range(rounds if len(rows) else 0):
            at = (rows @ now.T).argmax(axis=1)
            sums = np.zeros_like(now)
            np.add.at(sums, at, rows)
            now = np.where((np.bincount(at, minlength=len(now)) > 0)[:, None], _unit(sums), now)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(now)], pa.binary())], names=["model"])

    rows = points.join(F.broadcast(keys), key, "left_semi").select(vector).limit(SAMPLE).coalesce(1)
    found = pickle.loads(rows.mapInArrow(fit, "model binary").first()["model"])
    return found if len(found) > 1 else None


def _listed(rows: DataFrame, index: np.ndarray | None, probes: int) -> DataFrame:
    """``rows`` once for each of the ``probes`` lists nearest to its vector."""
    if index is None:
        return rows.withColumn("list", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(_matrix(batch.column(batch.schema.get_field_index("vector")))) @ index.T
                p = min(probes, near.shape[1])
                at = np.argpartition(-near, p - 1, axis=1)[:, :p] if p < near.shape[1] else np.tile(np.arange(p), (len(near), 1))
                yield batch.append_column("lists", pa.array(list(at.astype(np.int32)), pa.list_(pa.int32())))

    shape = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", lists array<int>"
    return rows.mapInArrow(run, shape).withColumn("list", F.explode("lists")).drop("lists")


def _blocks(rows: DataFrame, rows_a_block: int) -> DataFrame:
    """(kind, list, rows): the rows of each list in blocks of about ``rows_a_block``."""
    sizes = rows.groupBy("kind", "list").agg(F.ceil(F.count("*") / rows_a_block).alias("_parts"))
    dealt = rows.join(sizes, ["kind", "list"]).withColumn("_part", F.pmod(F.xxhash64("gid", "place"), F.col("_parts")))
    return dealt.groupBy("kind", "list", "_part").agg(F.collect_list(F.struct("gid", "place", "vector")).alias("rows")).drop("_part")


def _search(k: int, before: bool, gid: pa.DataType, c_gid: pa.DataType):
    schema = pa.schema([("gid", gid), ("c_gid", c_gid), ("cosine", pa.float64()), ("c_place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ours, theirs in zip(batch.column(0), batch.column(1), strict=True):
                a, b = ours.values, theirs.values
                x, y = _matrix(a.field("vector")), _matrix(b.field("vector"))
                if x.shape[1] != y.shape[1]:
                    raise ValueError("vectors differ in size")
                mine, places = a.field("place").to_numpy(), b.field("place").to_numpy()
                lx, ly = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
                scale = lx[:, None] * ly[None, :]
                near = np.divide(x @ y.T, scale, out=np.zeros(scale.shape), where=scale > 0)
                if before:
                    near[places[None, :] >= mine[:, None]] = -2.0
                at = max(near.shape[1] - k, 0)
                i, j = np.nonzero((near >= np.partition(near, at, axis=1)[:, at, None] - 1e-9) & (near > -1.5))
                exact = np.zeros(len(i))
                for c in range(0, len(i), 100_000):
                    p, q = i[c : c + 100_000], j[c : c + 100_000]
                    product = lx[p] * ly[q]
                    exact[c : c + 100_000] = np.divide((x[p] * y[q]).sum(axis=1), product, out=np.zeros(len(p)), where=product > 0)
                order = np.lexsort((places[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[kept], j[kept]
                yield pa.RecordBatch.from_arrays([a.field("gid").take(pa.array(i)), b.field("gid").take(pa.array(j)), pa.array(exact[kept]), pa.array(places[j], pa.int64())], schema=schema)

    return run


def nearest(queries: DataFrame, points: DataFrame, k: int, index: np.ndarray | None = None, probes: int = PROBES, before: bool = False, block: int = BLOCK) -> DataFrame:
    """(gid, c_gid, cosine): for each row of ``queries`` the ``k`` most similar rows of ``points`` of its kind, ties to the smaller place.

    Both are (gid, kind, place, vector); rows without a kind or a vector meet none.  ``before`` keeps to points of a smaller place
    than the row's own.  A zero vector is at cosine 0 from all.
    """
    small_batches(queries.sparkSession)
    shape = lambda d: d.select("gid", "kind", F.col("place").cast("long").alias("place"), F.col("vector").cast("array<double>").alias("vector")).filter(F.col("kind").isNotNull() & F.col("vector").isNotNull())
    ours = _blocks(_listed(shape(queries), index, probes), block).withColumnRenamed("rows", "ours")
    theirs = _blocks(_listed(shape(points), index, 1), block).withColumnRenamed("rows", "theirs")
    types = queries.schema["gid"].dataType, points.schema["gid"].dataType
    pair = StructType([StructField("gid", types[0]), StructField("c_gid", types[1]), StructField("cosine", DoubleType()), StructField("c_place", LongType())])
    found = ours.join(theirs, ["kind", "list"]).select("ours", "theirs").mapInArrow(_search(k, before, *map(to_arrow_type, types)), pair)
    return ranked(found, [F.desc("cosine"), "c_place"], ("gid",), k, "_near").select("gid", "c_gid", "cosine")


def kind_of(columns: list[Column]) -> Column:
    """One value for rows that agree in all ``columns``; null, which meets none, where one is null."""
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return F.when(known, F.concat_ws("\x1f", F.lit(""), *[c.cast("string") for c in columns]))
