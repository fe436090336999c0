"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

SuperMinHash gives an element a random permutation of the signature's places, one for all places, and at
place p(j) the rank j plus a uniform fraction.  Ranks of one element are therefore correlated (all different),
which lowers the variance, and once every place of a set holds a value below j no later rank can matter, so
a set stops after a few ranks however long the signature is.

1. One pass over the texts: set size, a 128-bit digest of the set, and the banded signature.
2. Documents with equal sets form a class; only its smallest doc_id goes on, so copies cost one row.
3. A band's bucket is led by its smallest class; a class joins the group of every leader that it shares a
   bucket with.  Any two classes that share a bucket share its leader's group, so groups hold all candidate
   pairs, and bands that agree add nothing.
4. A group is dealt into blocks of bounded size.  First every block meets its leader: all pairs of that cell are
   compared on full sets, and only the links that a union-find over the cell still needs leave it.  That is linear
   in the group, and settles groups of one block.
5. Where a larger group then still falls into several components, its members outside the group's largest component
   meet every block, and pairs of different components are compared.  Pairs within one component need no
   comparison, so none that could matter is left out.
6. Cells are dealt to tasks by number, a group's cells one task after the other, so no task gets many of them.
7. Connected components over all links by large-star and small-star rounds, each a shared table.

Edge cases: null, empty and wordless texts have an empty set and are linked with nothing; rows with a null id
are grouped with nothing (component null, kept); rows that repeat an id are each reported; ties cannot occur,
as the smallest id leads; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .bytetext import SHINGLE_MULT, U, chunks, mix, shingle_sets
from .storage import discard, materialize

BANDS, ROWS = 32, 4
NUM, DEN = 75, 100  # a link: DEN * intersection >= NUM * union
#: Documents of a block, and shingles that a block holds about at most; a lone document may have more.
BLOCK_DOCS, BLOCK_SHINGLES = 64, 200_000
#: Blocks of the second comparison are so many times larger.
WIDER = 4
#: Where the second comparison needs so few copies of sets, the cells go to the texts by a broadcast of about 40 bytes each.
BROADCAST_CELLS = 500_000


def super_minhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signatures of many sets at once, shape (sets, places); of an empty set, infinities."""
    out = np.full((len(sets), places), np.inf)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None  # each live element's permutation, once it is needed
    first = None
    for j in range(places):
        if not len(items):
            break
        u = mix(items + U((2 * j + 1) * 0xD1B54A32D192ED03 % 2**64))
        pick = j + ((u & U(0xFFFFFFFF)) * U(places - j) >> U(32)).astype(np.int64)
        rank = j + (u >> U(32)).astype(np.float64) * 2.0**-32 + (mix(u) >> U(44)).astype(np.float64) * 2.0**-52
        if j == 0:
            place, first = pick, pick
        elif j == 1:
            # after the first exchange place 0's old holder stands at `first`
            place = np.where(pick == first, 0, pick)
        else:
            rows = np.arange(len(items))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, j]
            order[rows, j] = place
        np.minimum.at(flat, owner * places + place, rank)
        live = (out.max(axis=1) > j + 1)[owner]
        if j == 1 and live.any():
            one, two = first[live], pick[live]
            order = np.tile(np.arange(places, dtype=np.int16), (len(one), 1))
            rows = np.arange(len(one))
            order[rows, one] = 0
            order[rows, 0] = one
            held = order[rows, two].copy()
            order[rows, two] = order[rows, 1]
            order[rows, 1] = held
        elif j > 1 and not live.all():
            order = order[live]
        if not live.all():
            items, owner = items[live], owner[live]
            first = first[live]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signatures.reshape(-1, bands, rows).view(np.uint64)
    keys = (bits * SHINGLE_MULT[:rows]).sum(axis=2, dtype=np.uint64) + SHINGLE_MULT[8] * np.arange(1, bands + 1, dtype=np.uint64)
    return mix(keys).view(np.int64)


def _sketches(width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in chunks(text, 1 << 19):
                sets = shingle_sets(data, offsets, width)
                keys = band_keys(super_minhash(sets, bands * rows), bands, rows)
                digests = np.array([[s.sum(dtype=np.uint64), mix(s * SHINGLE_MULT[9]).sum(dtype=np.uint64)] for s in sets], dtype=np.uint64).view(np.int64)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)), pa.array(keys[sizes > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), lists], schema=schema)

    return run


CELL = "slot int, leader long, i int, j int, side int, component long"
#: Bytes of sets in an Arrow batch on its way out of a worker.
OUT_BYTES = 4 << 20
SETS = f"{CELL}, doc_id long, shingles binary"


def _sets(width: int):
    fields = [("slot", pa.int32()), ("leader", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("component", pa.int64())]
    schema = pa.schema([*fields, ("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, cells = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, data, offsets in chunks(text, 1 << 19):
                held = [s.tobytes() for s in shingle_sets(data, offsets, width)]
                own = cells.slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy())
                flat, names = own.flatten(), ids.slice(lo, hi - lo)
                ends = np.cumsum(np.array([len(h) for h in held], dtype=np.int64)[owner])
                a = 0
                while a < len(owner):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + OUT_BYTES, side="right")))
                    part = flat.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*(part.field(k) for k, _ in fields), names.take(pa.array(owner[a:b])), pa.array([held[x] for x in owner[a:b].tolist()], pa.binary())], schema=schema)
                    a = b

    return run


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _linked(inter: int, a: int, b: int) -> bool:
    return DEN * inter >= NUM * (a + b - inter)


def links_of(ids: list[int], sides: list[int], known: list[int | None], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of one cell that connect what its full comparison connects.

    Pairs on one side are compared only in a cell of one side.  Documents whose ``known`` component is the same need no
    link.  Links given are at most one less than the documents.
    """
    n = len(ids)
    parent, out = list(range(n)), []
    cross = len(set(sides)) > 1
    sizes = [len(s) for s in sets]
    first: dict[int, int] = {}
    for x, c in enumerate(known):
        if c is not None:
            parent[x] = first.setdefault(c, x)

    def join(x: int, y: int) -> None:
        rx, ry = _root(parent, x), _root(parent, y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((ids[x], ids[y]))

    if n <= 12:
        for x in range(n):
            for y in range(x):
                if (not cross or sides[x] != sides[y]) and DEN * min(sizes[x], sizes[y]) >= NUM * max(sizes[x], sizes[y]) and _root(parent, x) != _root(parent, y):
                    if _linked(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), sizes[x], sizes[y]):
                        join(x, y)
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = number[code[keep]], owner[keep]
    by_code = np.argsort(code, kind="stable")
    code, owner = code[by_code], owner[by_code]
    # rows and columns of the product: the two sides, or all with all
    side = np.array(sides)
    left = np.flatnonzero(side == side.min()) if cross else np.arange(n)
    right = np.flatnonzero(side != side.min()) if cross else left
    inter = np.zeros((len(left), len(right)), dtype=np.float64)
    step = 4096
    total = int(shared.sum())
    cuts = np.searchsorted(code, np.arange(0, total + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            block = np.zeros((n, step), dtype=np.float32)
            block[owner[a:b], code[a:b] - k * step] = 1
            inter += block[left] @ block[right].T  # each product is exact: sums of at most 4096 ones
    size = np.array(sizes, dtype=np.float64)
    hit = DEN * inter >= NUM * (size[left][:, None] + size[right][None, :] - inter)
    x, y = np.nonzero(hit if cross else np.tril(hit, -1))
    for a, b in zip(left[x].tolist(), right[y].tolist(), strict=True):
        join(a, b)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; one cell is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key, cell = None, ([], [], [], [])
    pending: list[tuple[int, int]] = []

    def flush() -> None:
        if len(cell[0]) > 1:
            pending.extend(links_of(*cell))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pending], pa.int64()), pa.array([p[1] for p in pending], pa.int64())], schema=schema)
        pending.clear()
        return batch

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(1, 8)]
        for leader, i, j, side, component, doc, held in zip(*columns, strict=True):
            if (leader, i, j) != key:
                flush()
                key, cell = (leader, i, j), ([], [], [], [])
            for own, value in zip(cell, (doc, side, component, np.frombuffer(held, dtype=np.uint64)), strict=True):
                own.append(value)
        if len(pending) > 10_000:
            yield out()
    flush()
    yield out()


def _slot(cell: Column, parts: int) -> Column:
    """The task of a cell: a group's cells go to one task after the other, from one that its leader's hash picks."""
    return (F.pmod(F.xxhash64("leader"), F.lit(parts)) + F.pmod(cell, F.lit(parts))).cast("int") % parts


def _compared(docs: DataFrame, cells: DataFrame, width: int, parts: int, few: bool) -> DataFrame:
    """``cells`` (doc_id and the fields of CELL): links (a, b) that comparing each cell's documents gives."""
    fields = [c.split()[0] for c in CELL.split(", ")]
    own = cells.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("cells"))
    one = docs.join(F.broadcast(own) if few else own, "doc_id").select("doc_id", "text", "cells")
    sets = one.mapInArrow(_sets(width), SETS)
    return sets.repartitionById(parts, "slot").sortWithinPartitions("leader", "i", "j", "side", "doc_id").mapInArrow(_verify, "a long, b long")


def _blocks(docs: Column, shingles: Column, block_docs: int) -> Column:
    return F.greatest(F.ceil(docs / block_docs), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("class_id"), blocks).cast("int")


def near_duplicates(documents: DataFrame, width: int = 5, bands: int = BANDS, rows: int = ROWS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``documents`` (doc_id, text): n_shingles, component_id and kept for each document row.

    Word shingles of ``width``; a link needs a Jaccard similarity of 0.75.  With 32 bands of 4 rows a pair at
    that similarity misses every bucket with a chance below 1e-5.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialize(docs.mapInArrow(_sketches(width, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"), "sketches")
    real = sketch.filter("n_shingles > 0 and doc_id is not null")
    digest = ["d1", "d2", "n_shingles"]
    classes = materialize(real.groupBy(*digest).agg(F.min("doc_id").alias("class_id"), F.first("keys").alias("keys")), "classes")

    buckets = classes.select("class_id", "n_shingles", F.explode("keys").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("class_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader")
    # a table of its own, so that the join shuffles both sides and a bucket of very many classes can be split
    leaders = materialize(leaders, "leaders")
    members = materialize(buckets.join(leaders, "key").select("leader", "class_id", "n_shingles").distinct(), "groups")
    discard(leaders)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    shape = members.groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    shape = materialize(shape.select("leader", _blocks(F.col("n"), F.col("w"), block_docs).alias("blocks"), _blocks(F.col("n"), F.col("w"), block_docs * WIDER).alias("wide")), "group-shapes")

    # first comparison: every block with its group's leader
    dealt = members.join(shape, "leader").select("leader", "class_id", _dealt(F.col("blocks")).alias("i"))
    led = shape.select("leader", F.col("leader").alias("class_id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    met = dealt.filter("class_id <> leader").unionByName(led)
    cell = [F.col("class_id").alias("doc_id"), _slot(F.col("i"), parts).alias("slot"), "leader"]
    none = F.lit(None).cast("long").alias("component")
    links = materialize(_compared(docs, met.select(*cell, "i", F.lit(0).alias("j"), F.lit(0).alias("side"), none), width, parts, False), "links-of-blocks")
    roots = materialize(components(links).select("id", F.col("component").alias("root")), "roots-of-blocks")
    discard(links)

    # second comparison: in groups of several components, all members with those outside the largest
    many = members.join(shape.filter("blocks > 1"), "leader").join(roots, F.col("class_id") == F.col("id"), "left")
    many = materialize(many.select("leader", "class_id", "n_shingles", "wide", F.coalesce("root", "class_id").alias("component")), "large-groups")
    parted = many.groupBy("leader", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), F.max("wide").alias("wide"))
    parted = parted.groupBy("leader").agg(F.max(F.struct("n", "w", "component")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("wide").alias("wide")).filter("n > most.n")
    rest_n, rest_w = F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")
    parted = parted.select("leader", F.col("most.component").alias("largest"), _blocks(rest_n, rest_w, block_docs).alias("rest"), rest_n.alias("rest_n"), "n", "wide")
    parted = materialize(parted.select("leader", "largest", "rest", (F.col("rest_n") * F.col("wide") + F.col("n") * F.col("rest")).alias("copies")), "parted-groups")
    open_groups = parted.agg(F.count("*").alias("groups"), F.sum("copies").alias("copies")).first()
    if open_groups["groups"]:
        own = many.join(parted, "leader")
        outside = own.filter("component <> largest").select("leader", "class_id", "component", "wide", F.col("rest"), _dealt(F.col("rest")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), F.lit(0).alias("side"))
        inside = own.select("leader", "class_id", "component", "wide", F.col("rest"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("i"), _dealt(F.col("wide")).alias("j"), F.lit(1).alias("side"))
        met = outside.unionByName(inside).withColumn("nth", F.col("i") * F.col("wide") + F.col("j"))
        met = met.select(F.col("class_id").alias("doc_id"), _slot(F.col("nth"), parts).alias("slot"), "leader", "i", "j", "side", "component")
        more = _compared(docs, met, width, parts, open_groups["copies"] <= BROADCAST_CELLS)
        tree = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
        roots = components(tree.unionByName(more)).select("id", F.col("component").alias("root"))

    of_class = materialize(classes.select(*digest, "class_id").join(roots, F.col("class_id") == F.col("id"), "left").select(*digest, F.coalesce("root", "class_id").alias("component")), "components")
    return sketch.select("doc_id", *digest).join(of_class, digest, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
