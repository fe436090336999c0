"""The property graph as tables, and its fixed traversal templates for batches of starting points.

Edges are ``relates`` (src_id, dst_id, type, confidence, chunk_id, doc_id), ``mentions`` (chunk_id, entity_id, confidence).
A path is (query_id, path_rank, nodes, chunk_ids, hops, score): node ids in order, the distinct chunks of its
edges in order, and the mean confidence of its edges.  Every order is total, so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from . import tables
from .fusion import ranked

TEMPLATES = ("neighbors", "path_between", "entities_by_relation", "co_mentioned", "top_entities_for_chunks")
RELATION_KEY = ["src_id", "dst_id", "type", "chunk_id", "doc_id"]
MENTION_KEY = ["chunk_id", "entity_id", "char_start", "char_end"]
PATH = ["query_id", "path_rank", "nodes", "chunk_ids", "hops", "score"]


def undirected(relates: DataFrame) -> DataFrame:
    """Each edge from both its ends as (a, b, ...); a self-loop once."""
    rest = [c for c in relates.columns if c not in ("src_id", "dst_id")]
    forth = relates.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), *rest)
    back = relates.filter("src_id <> dst_id").select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), *rest)
    return forth.unionByName(back)


def mean_confidence(confidences: Column) -> Column:
    n = F.size(confidences)
    return F.when(n > 0, F.aggregate(confidences, F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)


def _sorted_chunks(*ids: str) -> Column:
    return F.array_sort(F.array_distinct(F.array(*ids)))


def neighbors(starts: DataFrame, relates: DataFrame, per_hop_cap: int = 25, max_paths: int = 40) -> DataFrame:
    """``starts`` (query_id, entity_id): paths of one and two hops over the strongest edges.

    Both hops keep ``per_hop_cap`` edges by confidence, the second for each row of the first and never back to the
    start.  ``max_paths`` bounds rows, of which each gives its one-hop path once and, where there is one, a two-hop path.
    """
    edges = undirected(relates).select("a", "b", "type", "confidence", "chunk_id", "doc_id")
    tie = [F.desc("confidence"), "b", "chunk_id", "type", "doc_id"]
    one = tables.sent(starts.select("query_id", F.col("entity_id").alias("a"))).join(edges, "a")
    one = ranked(one, tie, ("query_id",), per_hop_cap, "r1").select("query_id", "r1", F.col("a").alias("start"), F.col("b").alias("n1"), F.col("confidence").alias("c1"), F.col("chunk_id").alias("k1"))
    second = edges.select(F.col("a").alias("n1"), F.col("b").alias("n2"), F.col("confidence").alias("c2"), F.col("chunk_id").alias("k2"), F.col("type").alias("t2"), F.col("doc_id").alias("d2"))
    # the strongest edges of a node are the same for every row that reaches it from one start
    two = one.select("query_id", "start", "n1").distinct().join(second, "n1").filter("n2 <> start")
    two = ranked(two, [F.desc("c2"), "n2", "k2", "t2", "d2"], ("query_id", "n1"), per_hop_cap, "r2").select("query_id", "n1", "r2", "n2", "c2", "k2")
    rows = one.join(two, ["query_id", "n1"], "left")
    rows = ranked(rows, ["r1", F.asc_nulls_first("r2")], ("query_id",), max_paths, "row")
    hop1 = tables.first_by(rows, ["query_id", "n1", "k1"], ["row"])
    hop1 = hop1.select("query_id", (F.col("row") * 2).alias("at"), F.array("start", "n1").alias("nodes"), F.array("k1").alias("chunk_ids"), F.lit(1).alias("hops"), F.col("c1").alias("score"))
    hop2 = rows.filter("n2 is not null").select("query_id", (F.col("row") * 2 + 1).alias("at"), F.array("start", "n1", "n2").alias("nodes"), _sorted_chunks("k1", "k2").alias("chunk_ids"), F.lit(2).alias("hops"), mean_confidence(F.array("c1", "c2")).alias("score"))
    return ranked(hop1.unionByName(hop2), ["at"], name="path_rank").select(*PATH)


def path_between(pairs: DataFrame, relates: DataFrame) -> DataFrame:
    """``pairs`` (query_id, src_id, dst_id): one shortest undirected path of one or two edges, if there is one.

    Among the shortest, the greatest score and then the least nodes and chunks.  An entity has no path to itself.
    """
    edges = undirected(relates).select("a", "b", "confidence", "chunk_id")
    ends = pairs.filter("src_id <> dst_id").select("query_id", "src_id", "dst_id")
    one = ends.join(edges, (F.col("src_id") == F.col("a")) & (F.col("dst_id") == F.col("b")))
    one = one.select("query_id", F.array("src_id", "dst_id").alias("nodes"), F.array("chunk_id").alias("chunk_ids"), F.lit(1).alias("hops"), F.col("confidence").alias("score"))
    first = edges.select(F.col("a").alias("src_id"), F.col("b").alias("mid"), F.col("confidence").alias("c1"), F.col("chunk_id").alias("k1"))
    last = edges.select(F.col("a").alias("mid"), F.col("b").alias("dst_id"), F.col("confidence").alias("c2"), F.col("chunk_id").alias("k2"))
    # only edges of the asked ends, and of parallel ones only the best, can be on the chosen path
    first = tables.first_by(first.join(tables.sent(ends.select("src_id").distinct()), "src_id", "left_semi"), ["src_id", "mid"], [F.desc("c1"), "k1"])
    last = tables.first_by(last.join(tables.sent(ends.select("dst_id").distinct()), "dst_id", "left_semi"), ["mid", "dst_id"], [F.desc("c2"), "k2"])
    two = ends.join(one.select("query_id"), "query_id", "left_anti").join(first, "src_id").join(last, ["mid", "dst_id"]).filter("mid <> src_id and mid <> dst_id")
    two = two.select("query_id", F.array("src_id", "mid", "dst_id").alias("nodes"), _sorted_chunks("k1", "k2").alias("chunk_ids"), F.lit(2).alias("hops"), mean_confidence(F.array("c1", "c2")).alias("score"))
    return ranked(one.unionByName(two), ["hops", F.desc("score"), "nodes", "chunk_ids"], top=1, name="path_rank").select(*PATH)


def entities_by_relation(types: DataFrame, relates: DataFrame, max_paths: int = 40) -> DataFrame:
    """``types`` (query_id, relation_type): the strongest directed edges of a type, which are found once for all queries that ask for it."""
    best = relates.join(tables.sent(types.select(F.col("relation_type").alias("type")).distinct()), "type", "left_semi")
    order = [F.desc("confidence"), *[F.asc_nulls_last(c) for c in ("src_id", "dst_id", "chunk_id", "doc_id")]]
    best = ranked(best, order, ("type",), max_paths, "path_rank")
    found = types.join(best, F.col("relation_type") == F.col("type"))
    found = ranked(found.drop("path_rank"), order, top=max_paths, name="path_rank")  # of all types of a query
    return found.select("query_id", "path_rank", F.array("src_id", "dst_id").alias("nodes"), F.array("chunk_id").alias("chunk_ids"), F.lit(1).alias("hops"), F.col("confidence").alias("score"))


def co_mentioned(seeds: DataFrame, mentions: DataFrame, k: int = 40, per_hop_cap: int = 25) -> DataFrame:
    """``seeds`` (query_id, entity_id): entities that share one of the seed's strongest chunks; never the seed."""
    held = mentions.select("chunk_id", F.col("entity_id").alias("b"), "confidence", "char_start")
    chunks = seeds.join(held.withColumnRenamed("b", "entity_id"), "entity_id")
    chunks = ranked(chunks, [F.desc("confidence"), "chunk_id", "char_start"], ("query_id",), per_hop_cap, "_c").select("query_id", F.col("entity_id").alias("seed"), "chunk_id").distinct()
    others = chunks.join(held, "chunk_id").filter("b <> seed")
    others = ranked(others, [F.desc("confidence"), "b", "char_start"], ("query_id", "chunk_id"), per_hop_cap, "_m")
    others = others.select("query_id", "b", "chunk_id", "confidence").distinct()
    best = ranked(others, [F.desc("confidence"), "b", "chunk_id"], top=k, name="path_rank")
    return best.select("query_id", "path_rank", F.array("b").alias("nodes"), F.array("chunk_id").alias("chunk_ids"), F.lit(0).alias("hops"), F.col("confidence").alias("score"))


def top_entities_for_chunks(chunks: DataFrame, relates: DataFrame, max_paths: int = 40) -> DataFrame:
    """``chunks`` (query_id, chunk_id): entities by the number of distinct edges that touch them in those chunks."""
    edges = relates.withColumn("edge", F.struct(*RELATION_KEY)).select("chunk_id", "edge", F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("a"))
    degrees = chunks.select("query_id", "chunk_id").distinct().join(edges, "chunk_id").groupBy("query_id", "a").agg(F.count_distinct("edge").alias("degree"))
    best = ranked(degrees, [F.desc("degree"), "a"], top=max_paths, name="path_rank")
    return best.select("query_id", "path_rank", F.array("a").alias("nodes"), F.array().cast("array<string>").alias("chunk_ids"), F.lit(0).alias("hops"), F.col("degree").cast("double").alias("score"))


def traverse(template: str, params: DataFrame, relates: DataFrame, mentions: DataFrame, per_hop_cap: int = 25, max_paths: int = 40) -> DataFrame:
    """A template by name; caps always come from the settings, never from the caller's parameters."""
    if template == "neighbors":
        return neighbors(params, relates, per_hop_cap, max_paths)
    if template == "path_between":
        return path_between(params, relates)
    if template == "entities_by_relation":
        return entities_by_relation(params, relates, max_paths)
    if template == "co_mentioned":
        return co_mentioned(params, mentions, max_paths, per_hop_cap)
    if template == "top_entities_for_chunks":
        return top_entities_for_chunks(params, relates, max_paths)
    raise ValidationError(f"unknown template {template!r}", details={"template": template, "known": sorted(TEMPLATES)})


def best_paths(paths: DataFrame, max_hops: Column | int, max_paths: int = 40) -> DataFrame:
    """Paths within the hop limit, the best first; equal scores keep their order."""
    limit = F.lit(max_hops) if isinstance(max_hops, int) else max_hops
    return ranked(paths.filter(F.col("hops") <= limit), [F.desc("score"), "path_rank"], top=max_paths, name="_r").drop("path_rank").withColumnRenamed("_r", "path_rank")


def upsert_relations(relates: DataFrame, rows: DataFrame) -> DataFrame:
    rows = tables.require_keys(rows, ["chunk_id", "doc_id"], "relations")
    return tables.merge_rows(relates, rows, RELATION_KEY, [F.desc("confidence"), "evidence_span"])


def upsert_mentions(mentions: DataFrame, rows: DataFrame) -> DataFrame:
    rows = tables.require_keys(rows, ["chunk_id", "entity_id"], "mentions")
    return tables.merge_rows(mentions, rows, MENTION_KEY, [F.desc("confidence"), "surface"])


def upsert_entities(entities: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    return tables.merge_rows(entities, rows, ["canonical_id"], ["name"], {"created_at": now})


def upsert_documents(documents: DataFrame, rows: DataFrame) -> DataFrame:
    return tables.merge_rows(documents, rows, ["doc_id"], ["uri"])


def add_aliases(aliases: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """An alias keeps when it was decided; the entity that loses its name stays."""
    return tables.merge_rows(aliases, rows, ["alias_id", "canonical_id"], [F.desc("score"), "method"], {"decided_at": now})


def delete_document(documents: DataFrame, has_chunk: DataFrame, chunks: DataFrame, mentions: DataFrame, relates: DataFrame, ids: DataFrame, cascade_relations: bool = False) -> dict[str, DataFrame]:
    """Delete documents, the chunks that no other document holds, and the edges of both.

    Relations keep naming deleted chunks unless ``cascade_relations`` is set: provenance is their property, no edge.
    """
    dead = ids.select("doc_id").distinct()
    mine = has_chunk.join(dead, "doc_id", "left_semi").select("chunk_id").distinct()
    alive = has_chunk.join(dead, "doc_id", "left_anti").select("chunk_id").distinct()
    gone = mine.join(alive, "chunk_id", "left_anti")
    return {
        "documents": tables.delete_ids(documents, dead, "doc_id"),
        "has_chunk": tables.delete_ids(has_chunk, dead, "doc_id"),
        "chunks": tables.delete_ids(chunks, gone, "chunk_id"),
        "mentions": tables.delete_ids(mentions, gone, "chunk_id"),
        "relates": tables.delete_ids(relates, gone, "chunk_id") if cascade_relations else relates,
    }
