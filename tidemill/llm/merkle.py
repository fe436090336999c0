"""A Merkle manifest of a dataset: a leaf for each row, a tree for each language, a root over the trees, and a proof for each row.

Leaves get their place inside their language by range partitions, so a language may hold any share of the rows.  Blocks of consecutive
leaves (a power of two) are reduced where they lie, each to one node; nodes are reduced the same way again until few are left.  The
driver builds the tree above those, which is bounded by ``top`` nodes, and broadcasts each node's suffix path: siblings up to the
language's subroot and from there to the root.  Executors then finish the proofs from the top down and fold each row on its own.
Where there are more than ``top`` languages their subroots are reduced in blocks too, before the driver takes over.

A node without a sibling is hashed alone.  H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex text.

Edge cases: a null is a field of its own (``-``); rows without an id come first in their language, rows that share an id by their leaf;
repeated rows are leaves of their own; a null language is a tree of its own, the first one; a tree of one leaf has that leaf as its
subroot, and a single subroot is the root; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import positions
from .storage import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Path of a node: for each level the side and digest of its sibling, or only LONE.
LEFT, RIGHT, LONE = "L", "R", "-"
SUFFIX = "tree string, place long, subroot string, root string, path string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: dict[str, Column]) -> Column:
    """H of the fields, each null as ``-`` and else its UTF-8 length, a colon and the value."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(values[f]) for f in FIELDS]), 256)


def levels_of(nodes: list[str], height: int = 0) -> list[list[str]]:
    """The levels of a tree over ``nodes``, lowest first; it is at least ``height`` levels high, with lone nodes hashed alone."""
    levels = [nodes]
    while len(levels[-1]) > 1 or len(levels) <= height:
        below = levels[-1]
        levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def path_of(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(side, sibling) for each level below the top one."""
    steps = []
    for level in levels[:-1]:
        other = at ^ 1
        steps.append((LEFT if other < at else RIGHT, level[other]) if other < len(level) else (LONE, ""))
        at >>= 1
    return steps


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    for side, other in steps:
        node = h(other, node) if side == LEFT else h(node, other) if side == RIGHT else h(node)
    return node


def packed(steps: list[tuple[str, str]]) -> str:
    return "".join(side + other for side, other in steps)


def unpacked(path: str) -> list[tuple[str, str]]:
    steps, at = [], 0
    while at < len(path):
        end = at + (1 if path[at] == LONE else 65)
        steps.append((path[at], path[at + 1 : end]))
        at = end
    return steps


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` (tree, place, ...) with up to 2 ** bits consecutive ones of a tree in a row: (tree, block, entries), as a table."""
    rest = [c for c in nodes.columns if c not in ("tree", "place")]
    rows = nodes.groupBy("tree", F.shiftright("place", bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", *rest))).alias("entries"))
    return materialize(rows, "blocks")


def _height(block: int, bits: int) -> int:
    """The first block may be the whole tree and then ends at its single node; others reach the height of full blocks."""
    return bits if block else 0


def _roots(blocks: DataFrame, bits: int) -> DataFrame:
    """The node that each block reduces to: (tree, place, node), as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block, entries in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found.append(levels_of(entries.values.field("node").to_pylist(), _height(block, bits))[-1][0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["tree", "place", "node"])

    entries = F.transform("entries", lambda e: F.struct(e["node"].alias("node")))
    return materialize(blocks.select("tree", "block", entries.alias("entries")).mapInArrow(run, "tree string, place long, node string"), "roots")


def _met(blocks: DataFrame, suffixes: DataFrame) -> DataFrame:
    above = suffixes.withColumnsRenamed({"tree": "_tree", "place": "_place"})
    return blocks.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_place"))).drop("_tree", "_place")


def _lower(blocks: DataFrame, suffixes: DataFrame, bits: int) -> DataFrame:
    """The suffix of each node in ``blocks`` from those of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, entries, subroot, root, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                levels = levels_of([e["node"] for e in entries], _height(block, bits))
                own = [packed(path_of(levels, k)) + path for k in range(len(entries))]
                n = len(entries)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.string()), pa.array([e["place"] for e in entries], pa.int64()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(own, pa.string())], names=["tree", "place", "subroot", "root", "path"])

    rows = _met(blocks, suffixes).select("tree", "block", F.transform("entries", lambda e: F.struct(e["place"].alias("place"), e["node"].alias("node"))).alias("entries"), "subroot", "root", "path")
    return materialize(rows.mapInArrow(run, SUFFIX), "suffixes")


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(blocks: DataFrame, suffixes: DataFrame, bits: int) -> DataFrame:
    """The proof of each leaf, and its own fold of the leaf as presented."""
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_()}.get(c.split()[1], pa.string())) for c in PROVED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block, entries, subroot, root, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                leaves = [e["node"] for e in entries]
                levels, above = levels_of(leaves, _height(block, bits)), unpacked(path)
                tail = "".join(other for _, other in above)
                ends: dict[str, str] = {}  # what a block's node folds to, for all rows that reach the same one
                rows = []
                for at, e in enumerate(entries):
                    steps = path_of(levels, at)
                    reached = fold(e["presented"] or e["node"], steps)
                    end = ends.get(reached) or ends.setdefault(reached, fold(reached, above))
                    rows.append((e["doc_id"], e["node"], subroot, root, h(*[other for _, other in steps], tail), end, end == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _met(blocks, suffixes).select("tree", "block", "entries", "subroot", "root", "path").mapInArrow(run, PROVED)


def _upper(nodes: list[tuple[str | None, int, str]]) -> list[tuple[str | None, int, str, str, str]]:
    """The driver's part: trees over few nodes (tree, place, node), the root over them, and each node's suffix."""
    trees: dict[str | None, list[str]] = {}
    for tree, _, node in sorted(nodes, key=lambda n: (n[0] is not None, (n[0] or "").encode(), n[1])):
        trees.setdefault(tree, []).append(node)
    built = {t: levels_of(own) for t, own in trees.items()}
    whole = levels_of([built[t][-1][0] for t in trees]) if trees else []
    found = []
    for k, (tree, levels) in enumerate(built.items()):
        to_root = packed(path_of(whole, k))
        found += [(tree, at, levels[-1][0], whole[-1][0], packed(path_of(levels, at)) + to_root) for at in range(len(levels[0]))]
    return found


def _climb(nodes: DataFrame, bits: int, top: int) -> tuple[list[DataFrame], DataFrame]:
    """Reduce ``nodes`` by blocks at least once, until ``top`` are left or every tree has one: the blocks of each round, and what is left."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, bits))
        nodes = _roots(rounds[-1], bits)
        left = nodes.agg(F.count("*").alias("n"), F.max("place").alias("last")).first()
        if left["n"] <= top or not left["last"]:
            return rounds, nodes


def manifest(documents: DataFrame, presented: dict[str, Column] | None = None, bits: int = 10, top: int = 4096) -> DataFrame:
    """``documents`` (doc_id, source, lang, n_chars, text): leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    ``presented`` names columns whose values at verification differ from those of the manifest: folded_root then starts from the leaf of
    the row as presented, with the siblings of the manifest; verified says whether it ends at the root.  ``bits`` is the height of a
    block, ``top`` the most nodes that the driver holds.
    """
    spark = documents.sparkSession
    own = {f: F.col(f) for f in FIELDS}
    changed = [~c.eqNullSafe(own[f]) for f, c in (presented or {}).items()]
    other = F.when(F.array_contains(F.array(*changed), True), leaf(own | presented)) if changed else F.lit(None).cast("string")
    leaves = documents.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("node"), other.alias("presented"))
    placed = positions(leaves, [F.col("doc_id").asc_nulls_first(), "node"], ["tree"], "place")
    rounds, nodes = _climb(placed.select("tree", "place", "doc_id", "node", "presented"), bits, top)
    over = nodes.count() > top
    if over:  # more trees than the driver holds: their subroots are reduced like leaves
        subroots = positions(nodes.select(F.col("tree").alias("own"), "node"), [F.col("own").asc_nulls_first()], name="place").withColumn("tree", F.lit(None).cast("string"))
        subroots = materialize(subroots, "subroots")
        upper, nodes = _climb(subroots.select("tree", "place", "node"), bits, top)
    suffixes = F.broadcast(spark.createDataFrame(_upper([(r["tree"], r["place"], r["node"]) for r in nodes.collect()]), SUFFIX))
    if over:
        for blocks in reversed(upper):
            suffixes = _lower(blocks, suffixes, bits)
        suffixes = subroots.withColumnRenamed("place", "_at").join(suffixes.select("place", "root", "path"), F.col("_at") == F.col("place")).select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("node").alias("subroot"), "root", "path")
    for blocks in reversed(rounds[1:]):
        suffixes = _lower(blocks, suffixes, bits)
    return _proved(rounds[0], suffixes, bits)
