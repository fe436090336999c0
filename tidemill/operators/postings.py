"""An inverted index of term frequencies in shards, and top-k search that skips what cannot be among the best.

A shard holds the postings of some chunks in one row.  Its chunks stand by falling length, in ranges of ``RANGE``; a term's postings are
blocks, one for each range that has the term, with the greatest frequency of each.  The sum of a query's weights times those bounds every
score of a range.  Ranges are read from the one that may hold most, a few at a time; the k-th best score so far rises with them, and
the ranges whose bound lies below it are never read.  Scores are those of the full sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..session import small_batches
from ..shared import materialize
from .fusion import ranked

#: Postings of a shard, at most, but for one chunk's.
POSTINGS = 1_000_000
#: Chunks of a range.
RANGE = 64
#: Query terms of a block of queries, about, and blocks that are sent to the shards at once.
QUERY_TERMS = 50_000
WAVE = 8
#: Sums closer than this count as equal while ranges are left out; scores are rounded to nine digits.
EPSILON = 1e-8
ARRAYS = {"blocks": "<i8", "cuts": "<i8", "ranges": "<i4", "tops": "<f8", "docs": "<i4", "tfs": "<f8"}


def _shard(number: int, table: pa.Table) -> pa.RecordBatch:
    """The index row of some chunks' rows (key, term, tf), those of a chunk together."""
    keys = table.column(0).combine_chunks()
    tfs = table["tf"].to_numpy().astype("<f8")
    codes = keys.dictionary_encode()
    own = codes.indices.to_numpy(zero_copy_only=False)
    # the longest chunks first, equal ones by key
    lengths = np.bincount(own, weights=tfs, minlength=len(codes.dictionary))
    by_key = np.empty(len(lengths), np.int64)
    by_key[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(lengths))
    order = np.lexsort((by_key, -lengths))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms = table["term"].combine_chunks().dictionary_encode()
    term, docs = terms.indices.to_numpy(zero_copy_only=False), place[own]
    rows = np.lexsort((docs, term))
    term, docs, tfs = term[rows], docs[rows].astype("<i4"), tfs[rows]
    cuts = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(docs // RANGE) != 0)))
    found = {"ranges": docs[cuts] // RANGE, "tops": np.maximum.reduceat(tfs, cuts), "blocks": np.searchsorted(term[cuts], np.arange(len(terms.dictionary) + 1)), "cuts": np.append(cuts, len(docs)), "docs": docs, "tfs": tfs}
    fields = {"shard": pa.array([number], pa.int64()), "keys": pa.array([codes.dictionary.take(pa.array(order)).to_pylist()], pa.list_(keys.type)), "terms": pa.array([terms.dictionary.to_pylist()], pa.list_(pa.string()))}
    return pa.RecordBatch.from_pydict(fields | {n: pa.array([found[n].astype(t).tobytes()], pa.binary()) for n, t in ARRAYS.items()})


def _shards(most: int):
    """Rows (key, term, tf, partition), sorted by key -> a row for each shard; a chunk is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            while n >= most:
                table = pa.concat_tables(held).combine_chunks()
                keys = table.column(0).chunk(0)
                change = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
                change = change[change >= most // 2]
                if not len(change):
                    break  # one chunk so far
                cut = int(change[max(np.searchsorted(change, most, "right") - 1, 0)])
                yield _shard((table["part"][0].as_py() << 32) + number, table.slice(0, cut))
                held, n, number = [table.slice(cut)], n - cut, number + 1
        if n:
            table = pa.concat_tables(held).combine_chunks()
            yield _shard((table["part"][0].as_py() << 32) + number, table)

    return run


def build(terms: DataFrame, key: str = "chunk_id", dealt: bool = False, most: int = POSTINGS) -> DataFrame:
    """The index of ``terms`` (key, term, tf), one row for each key and term, as a table.

    A shard has at most ``most`` postings, but for those of one chunk.  ``dealt`` says that a key's rows are in one partition already, as ``term_frequencies`` has them; they are not shuffled then.
    """
    small_batches(terms.sparkSession)
    kind = terms.schema[key].dataType
    rows = terms.select(key, "term", F.col("tf").cast("double").alias("tf")).filter(F.col("term").isNotNull() & F.col(key).isNotNull())
    rows = (rows if dealt else rows.repartition(F.col(key))).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    shape = StructType([StructField("shard", LongType()), StructField("keys", ArrayType(kind)), StructField("terms", ArrayType(StringType())), *[StructField(n, BinaryType()) for n in ARRAYS]])
    return materialize(rows.mapInArrow(_shards(most), shape), "postings")


def inverse_frequencies(index: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """(term, df, idf) from the index: a term's chunks are the postings of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                blocks, cuts = (np.frombuffer(batch.column(c)[r].as_py(), "<i8") for c in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0)[r].values, pa.array(np.diff(cuts[blocks]), pa.int64())], names=["term", "df"])

    counts = index.select("terms", "blocks", "cuts").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    counts = counts.join(F.broadcast(n_chunks.select(F.count("*").alias("n"))))  # one row
    return counts.select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of several runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths) if len(ends) else np.zeros(0, np.int64)


class Shard:
    """The postings of one row of the index; ``allowed`` are the places of the chunks that may be found (None: all)."""

    def __init__(self, terms: list[str], keys: int, allowed: list[int] | None, arrays: dict[str, bytes]):
        self.at = {t: n for n, t in enumerate(terms)}
        for n, t in ARRAYS.items():
            setattr(self, n, np.frombuffer(arrays[n], t))
        self.n_keys, self.n_ranges = keys, -(-keys // RANGE)
        self.allowed = None
        if allowed is not None:
            self.allowed = np.zeros(keys, bool)
            self.allowed[allowed] = True

    def best(self, query: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Places of the chunks that may have the ``k`` greatest sums, and those sums; the postings of the terms, and those read."""
        known = [(weight, n) for term, weight in query if weight > 0 and (n := self.at.get(term)) is not None]
        weights, terms = np.array([w for w, _ in known]), np.array([n for _, n in known], dtype=np.int64)
        counts = self.blocks[terms + 1] - self.blocks[terms]
        blocks = _runs(self.blocks[terms], counts)  # the blocks of all terms, and what each term weighs
        weights, ranges = np.repeat(weights, counts), self.ranges[blocks]
        sizes = self.cuts[blocks + 1] - self.cuts[blocks]
        bounds = np.bincount(ranges, weights=weights * self.tops[blocks], minlength=self.n_ranges)
        order = np.argsort(-bounds, kind="stable")
        order = order[: np.count_nonzero(bounds)]
        sums, chosen = np.zeros(self.n_keys), np.zeros(self.n_ranges, bool)
        least, done, step, read = 0.0, 0, -(-k // RANGE) + 1, 0
        while done < len(order) and bounds[order[done]] >= least - EPSILON:
            chosen[:] = False
            chosen[order[done : done + step]] = True
            now = np.flatnonzero(chosen[ranges])
            at = _runs(self.cuts[blocks[now]], sizes[now])
            sums += np.bincount(self.docs[at], weights=np.repeat(weights[now], sizes[now]) * self.tfs[at], minlength=self.n_keys)
            read += len(at)
            done, step = done + step, step * 2
            seen = sums if self.allowed is None else sums[self.allowed]
            if len(seen) > k:
                least = np.partition(seen, len(seen) - k)[len(seen) - k]
        able = np.flatnonzero((sums > 0) & (sums >= least - EPSILON) & (True if self.allowed is None else self.allowed))
        return able, sums[able], int(sizes.sum()), read


def _search(k: int, query: pa.DataType, key: pa.DataType, counted: bool):
    names = ["query_id", "postings", "read"] if counted else ["query_id", "key", "score"]
    kinds = [query, pa.int64(), pa.int64()] if counted else [query, key, pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, keys = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                number, queries = batch.column(0)[r].as_py(), batch.column(4 + len(ARRAYS))[r].as_py()
                if number != held:
                    keys = batch.column(1)[r].values
                    shard = Shard(batch.column(2)[r].as_py(), len(keys), batch.column(3)[r].as_py(), {n: batch.column(4 + c)[r].as_py() for c, n in enumerate(ARRAYS)})
                    held = number
                ids, counts, at, scores, work = [], [], [], [], []
                for q in queries:
                    able, sums, total, read = shard.best([(t["term"], t["weight"]) for t in q["terms"]], k)
                    sums = np.round(sums, 9)
                    if len(able) > k:  # ties at the k-th score go to the smaller key
                        least = np.partition(sums, len(sums) - k)[len(sums) - k]
                        able, sums = able[sums >= least], sums[sums >= least]
                    by_key = pc.sort_indices(keys.take(pa.array(able))).to_numpy()
                    order = by_key[np.argsort(-sums[by_key], kind="stable")][:k]
                    ids.append(q["query_id"])
                    counts.append(len(order))
                    at.append(able[order])
                    scores.append(sums[order])
                    work.append((total, read))
                if counted:
                    total, read = zip(*work, strict=True) if work else ((), ())
                    columns = [pa.array(ids, query), pa.array(total, pa.int64()), pa.array(read, pa.int64())]
                else:
                    own = pa.array(np.repeat(np.arange(len(ids)), counts))
                    columns = [pa.array(ids, query).take(own), keys.take(pa.array(np.concatenate(at) if at else [], pa.int64())), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def top_k(query_terms: DataFrame, index: DataFrame, k: int, key: str = "chunk_id", allowed: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """``query_terms`` (query_id, term, weight) against ``index``: the ``k`` chunks with the greatest sum of weight * tf, by score and key.

    ``allowed`` (key) keeps chunks before ranking.

    Blocks of queries go to the shards, a bounded wave of them at a time; no query comes to the driver, and each shard sends k
    chunks of a query.  With ``counted`` the rows are (query_id, postings, read): the postings of a query's terms, and those read.
    """
    spark = index.sparkSession
    kinds = query_terms.schema["query_id"].dataType, index.schema["keys"].dataType.elementType
    rows = query_terms.groupBy("query_id").agg(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight"))).alias("terms"), F.count("*").alias("n"))
    rows = materialize(rows, "queries")
    blocks = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // QUERY_TERMS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    if counted:
        shape = StructType([StructField("query_id", kinds[0]), StructField("postings", LongType()), StructField("read", LongType())])
    else:
        shape = StructType([StructField("query_id", kinds[0]), StructField("key", kinds[1]), StructField("score", DoubleType())])
    index = index.select("shard", "keys", "terms", *ARRAYS)
    if allowed is None:
        index = index.withColumn("allowed", F.lit(None).cast("array<int>"))
    else:
        places = index.select("shard", F.posexplode("keys").alias("place", key)).join(allowed.select(key).distinct(), key, "left_semi")
        index = index.join(places.groupBy("shard").agg(F.collect_list("place").alias("allowed")), "shard")
    index = index.select("shard", "keys", "terms", "allowed", *ARRAYS)
    found = None
    for wave in range(0, blocks, WAVE):
        part = rows.filter((F.col("block") >= wave) & (F.col("block") < wave + WAVE)).groupBy("block").agg(F.collect_list(F.struct("query_id", "terms")).alias("queries"))
        met = index.crossJoin(F.broadcast(part.select("queries")))  # a wave: at most about WAVE * QUERY_TERMS terms
        got = met.mapInArrow(_search(k, to_arrow_type(kinds[0]), to_arrow_type(kinds[1]), counted), shape)
        if counted:
            got = got.groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"))
        else:
            got = ranked(got.withColumnRenamed("key", key), [F.desc("score"), key], top=k)
        if blocks > WAVE:
            got = materialize(got, "wave")
        found = got if found is None else found.unionByName(got)
    return found if found is not None else spark.createDataFrame([], shape)
