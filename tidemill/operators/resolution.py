"""Entity resolution of a batch of mentions: normalise, group, block, score, band, cluster, name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Resolution
from ..functions.identity import entity_id
from ..functions.similarity import band, cosine, score_pair
from ..functions.text import normalize_entity_name
from ..shared import materialize
from .components import components
from .knn import LIST_ROWS, PROBES, centroids, kind_of, nearest
from .numbering import positions
from .tables import first_by


@dataclass
class Resolved:
    entities: DataFrame
    aliases: DataFrame
    flagged: DataFrame
    surfaces: DataFrame  # (surface, type, canonical_id) of this batch


def choose_names(mentions: DataFrame, group: list[str]) -> DataFrame:
    """The most frequent surface of each group; then the longest, then the first by code point."""
    counts = mentions.groupBy(*group, "surface").agg(F.count("*").alias("_n"))
    order = [F.desc("_n"), F.desc(F.length("surface")), "surface"]
    return first_by(counts, group, order).select(*group, F.col("surface").alias("name"))


def normalized(mentions: DataFrame, rules: Resolution) -> DataFrame:
    """Each distinct surface is normalised once."""
    names = mentions.select("surface").distinct()
    names = names.withColumn("name_normalized", normalize_entity_name(F.col("surface"), rules.suffixes, rules.honorifics))
    return mentions.join(names, "surface")


def groups_of(mentions: DataFrame, rules: Resolution) -> DataFrame:
    """(gid, name, name_normalized, type, n): mentions of one normalised name and type are one candidate entity."""
    own = normalized(mentions, rules)
    key = ["name_normalized", "type"]
    sizes = own.groupBy(*key).agg(F.count("*").alias("n"))
    named = choose_names(own, key).join(sizes, key)
    return named.select(entity_id(F.col("name"), F.col("type")).alias("gid"), "name", *key, "n")


def candidate_pairs(groups: DataFrame, persisted: DataFrame, rules: Resolution, block: list[str] | None = None, exact: bool = False, list_rows: int = LIST_ROWS, probes: int = PROBES) -> DataFrame:
    """Pairs to score: each group with its equals by name and type, its ``block_k`` nearest earlier groups and nearest persisted entities.

    ``groups`` (gid, name_normalized, type, vector) are ordered by name and type; ``persisted`` has canonical_id for
    gid.  Types must match if the rules say so, and with ``block`` the named columns too.  Nearness is the cosine of the vectors, however
    the names are spelled.  Neighbours are found through an inverted file, in which a group meets the lists of its ``probes`` nearest
    centroids (one list for ``list_rows`` rows); ``exact`` compares with all, and its work grows with the square of the table.
    """
    keys = (["type"] if rules.require_type_match else []) + list(block or [])
    kind = kind_of([F.col(c) for c in keys])
    known = persisted.withColumnRenamed("canonical_id", "gid")
    placed = materialize(positions(groups.select("gid", "name_normalized", "type", "vector", kind.alias("kind")), ["name_normalized", "type", "gid"], name="place"), "placed")
    legs = [(placed, placed, True)]
    if persisted.limit(1).count():
        theirs = positions(known.select("gid", "name_normalized", "type", "vector", kind.alias("kind")), ["name_normalized", "type", "gid"], name="place")
        legs.append((placed, materialize(theirs, "placed-known"), False))
    pairs = None
    for n, (ours, theirs, before) in enumerate(legs):
        index = None if exact else centroids(theirs, list_rows=list_rows)
        c = theirs.select(*[F.col(x).alias(f"c_{x}") for x in ("gid", "name_normalized", "type", "vector")])
        near = nearest(ours, theirs, rules.block_k, index, probes, before)
        if not before:  # equals are candidates even where very many others have the same vector
            same = ours.join(c, (F.col("name_normalized") == F.col("c_name_normalized")) & (F.col("type") == F.col("c_type")))
            same = same.select("gid", "c_gid", cosine(F.col("vector"), F.col("c_vector")).alias("cosine"))
            near = near.unionByName(same.join(near.select("gid", "c_gid"), ["gid", "c_gid"], "left_anti"))
        named = ours.select("gid", "name_normalized", "type").join(near, "gid").join(c.drop("c_vector"), "c_gid").withColumn("c_known", F.lit(not before)).withColumn("_leg", F.lit(n))
        pairs = named if pairs is None else pairs.unionByName(named)
    same = pairs["c_name_normalized"].eqNullSafe(pairs["name_normalized"]) & (pairs["c_type"] == pairs["type"])
    return first_by(pairs.withColumn("_leg", F.when(same, -1).otherwise(F.col("_leg"))), ["gid", "c_gid"], ["_leg"]).drop("_leg")


def resolve(mentions: DataFrame, persisted: DataFrame, embed, rules: Resolution | None = None, block: list[str] | None = None, exact: bool = False) -> Resolved:
    """``mentions`` (surface, type, ...) and ``persisted`` entities (canonical_id, name, name_normalized, type, mention_count).

    Mentions without a surface are in no entity.  ``embed`` takes a string column to a vector column.  A persisted entity keeps its id when a cluster holds it (the
    least id of several); otherwise a cluster's id is that of its chosen name and type.  An id that a run mints and
    the next finds persisted is the same, so runs converge; mention counts grow with each run.
    """
    rules = rules or Resolution()
    groups = materialize(groups_of(mentions, rules).withColumn("vector", embed(F.col("name_normalized"))))
    known = persisted.select("canonical_id", "name", "name_normalized", "type", "mention_count")
    pairs = candidate_pairs(groups, known.withColumn("vector", embed(F.col("name_normalized"))), rules, block, exact)
    # names are compared only where the score can still leave the lowest band
    best = rules.weight_jaro_winkler + rules.weight_token_set + rules.weight_cosine * F.col("cosine")
    pairs = pairs.filter(best > rules.reject_at)
    score = score_pair(F.col("name_normalized"), F.col("c_name_normalized"), F.col("type"), F.col("c_type"), F.col("cosine"), rules)
    scored = materialize(pairs.withColumn("score", score).withColumn("band", band(F.col("score"), rules)).select("gid", "c_gid", F.col("c_known").alias("known"), "score", "band"))
    merges = scored.filter("band = 'merge'")
    flagged = scored.filter((F.col("band") == "gray") & F.lit(rules.gray_action == "flag")).select(F.col("gid").alias("a_id"), F.col("c_gid").alias("b_id"), "score")

    roots = components(merges.select(F.col("gid").alias("a"), F.col("c_gid").alias("b")), max_size=rules.max_cluster_size)
    # An entity that links only to itself (the persisted form of a group) is a cluster of one id.
    own = merges.filter("gid = c_gid").select(F.col("gid").alias("id")).distinct().join(roots, "id", "left_anti").select("id", F.col("id").alias("component"))
    roots = roots.unionByName(own)
    members = groups.select("gid").distinct().join(roots, F.col("gid") == F.col("id"), "left").select("gid", F.coalesce("component", "gid").alias("cluster"))
    clustered = normalized(mentions, rules).join(groups.select("gid", "name_normalized", "type"), ["name_normalized", "type"]).join(members, "gid").select("cluster", "surface", "type", "gid")
    clustered = materialize(clustered)
    merged_known = merges.filter("known").select(F.col("c_gid").alias("canonical_id")).distinct().join(known, "canonical_id")
    merged_known = merged_known.join(roots, F.col("canonical_id") == F.col("id")).select(F.col("component").alias("cluster"), "canonical_id", F.col("name").alias("k_name"), F.col("type").alias("k_type"), "mention_count")
    winners = merged_known.groupBy("cluster").agg(F.min(F.struct("canonical_id", "k_type")).alias("w"), F.sum("mention_count").alias("k_count"), F.collect_set("k_name").alias("k_names"))

    names = choose_names(clustered, ["cluster"])
    # a cluster without a persisted member takes its type from its least group
    facts = clustered.groupBy("cluster").agg(F.count("*").alias("m_count"), F.collect_set("surface").alias("m_names"), F.min_by("type", "gid").alias("m_type"))
    table = facts.join(names, "cluster").join(winners, "cluster", "left")
    kind = F.coalesce("w.k_type", "m_type")
    entities = table.select(
        F.coalesce("w.canonical_id", entity_id(F.col("name"), kind)).alias("canonical_id"),
        "name",
        normalize_entity_name(F.col("name"), rules.suffixes, rules.honorifics).alias("name_normalized"),
        kind.alias("type"),
        F.array_sort(F.array_except(F.array_union("m_names", F.coalesce("k_names", F.array().cast("array<string>"))), F.array("name"))).alias("aliases"),
        (F.col("m_count") + F.coalesce("k_count", F.lit(0))).cast("long").alias("mention_count"),
        "cluster",
    )
    entities = materialize(entities)
    aliases = entities.select("canonical_id", "type", F.explode("aliases").alias("alias")).select(entity_id(F.col("alias"), F.col("type")).alias("alias_id"), "canonical_id", F.lit(1.0).alias("score"), F.lit("cluster").alias("method"))
    surfaces = clustered.select("cluster", "surface", "type").distinct().join(entities.select("cluster", "canonical_id"), "cluster").select("surface", "type", "canonical_id")
    return Resolved(entities.drop("cluster"), aliases, flagged, surfaces)


def surface_map(resolved: Resolved) -> DataFrame:
    """One canonical id for each surface (the least, where types differ)."""
    return resolved.surfaces.groupBy("surface").agg(F.min("canonical_id").alias("canonical_id"))


def attach_mentions(mentions: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Mentions with their entity; those whose surface is unresolved are dropped."""
    return mentions.drop("entity_id").join(surfaces.withColumnRenamed("canonical_id", "entity_id"), "surface")


def attach_relations(relations: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Relations whose two ends both resolve."""
    src = surfaces.select(F.col("surface").alias("src_surface"), F.col("canonical_id").alias("src_id"))
    dst = surfaces.select(F.col("surface").alias("dst_surface"), F.col("canonical_id").alias("dst_id"))
    return relations.join(src, "src_surface").join(dst, "dst_surface")


