"""The sink of resolution: a batch of mentions and relations becomes entities, aliases and edges of the graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Resolution
from ..operators import graph as G
from ..operators import ledger as ledgers
from ..operators import tables
from ..operators.resolution import Resolved, attach_mentions, attach_relations, resolve, surface_map
from ..schemas import ALIASES, ENTITIES, LEDGER, MENTIONS, RELATES
from ..shared import materialize


@dataclass(frozen=True)
class Graph:
    """The graph's tables and the ledger of its documents."""

    entities: DataFrame
    aliases: DataFrame
    mentions: DataFrame
    relates: DataFrame
    ledger: DataFrame
    version: int = 0


def empty_graph(spark) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (ENTITIES, f"{ALIASES}, decided_at timestamp", MENTIONS, RELATES, LEDGER)))


def sink(graph: Graph, mentions: DataFrame, relations: DataFrame, embed: Callable[[Column], Column], now: Column, rules: Resolution | None = None, documents: DataFrame | None = None) -> tuple[Graph, Resolved]:
    """Resolve ``mentions`` and write what comes of them.

    ``mentions`` (chunk_id, surface, type, char_start, char_end, confidence) and ``relations`` (chunk_id, doc_id,
    src_surface, dst_surface, type, confidence, evidence_span) whose surfaces stay unresolved are dropped.  Entities
    replace those of their id; aliases, mentions and relations are merged by their keys, so a batch that is run again
    adds no rows.  ``documents`` (doc_id) then go on from RESOLVING to INDEXED; those in other states stay as they are.
    """
    resolved = resolve(mentions, graph.entities, embed, rules)
    surfaces = materialize(surface_map(resolved), "surfaces")
    entities = tables.replace_rows(graph.entities, resolved.entities.select(*graph.entities.columns), ["canonical_id"], ["name"])
    aliases = G.add_aliases(graph.aliases, resolved.aliases, now)
    linked = attach_mentions(mentions, surfaces).select("chunk_id", "surface", "type", "char_start", "char_end", "confidence", "entity_id")
    related = attach_relations(relations, surfaces).select(*RELATES_COLUMNS)
    after = replace(
        graph,
        entities=materialize(entities, "entities"),
        aliases=materialize(aliases, "aliases"),
        mentions=materialize(G.upsert_mentions(graph.mentions, linked), "mentions"),
        relates=materialize(G.upsert_relations(graph.relates, related), "relates"),
        version=graph.version + 1,
    )
    if documents is not None:
        through = graph.ledger.filter("status = 'RESOLVING'").join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
        after = replace(after, ledger=materialize(ledgers.advance(graph.ledger, through.select("doc_id"), "INDEXED", now, after.version), "ledger"))
    return after, resolved


RELATES_COLUMNS = [c.split()[0] for c in RELATES.split(", ")]
