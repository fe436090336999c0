"""The two legs of retrieval, for a batch of queries: hybrid search and graph traversal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import GraphBackendUnavailable, RetrievalBackendUnavailable
from ..functions.scalars import query_text
from ..functions.text import tokens
from ..operators import graph
from ..operators.fusion import chunks_of_paths, fuse, ranked
from ..operators.search import dense_top_k, hybrid_search
from ..operators.tables import sent
from ..shared import materialize
from .ingest import Corpus


def vector_leg(queries: DataFrame, corpus: Corpus, idf: DataFrame, embed: Callable[[Column], Column], settings: Settings, filters: dict | None = None, empty: float = 0.0) -> DataFrame:
    """``queries`` (query_id, query): chunk_id, score and dense rank from 1 of the best chunks.  Blank queries find none; for ``empty`` see ``dense_top_k``."""
    real = queries.filter(F.trim("query") != "")
    dense = real.select("query_id", embed(query_text(F.col("query"), settings.embedding)).alias("vector"))
    terms = real.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("tf"))
    r = settings.retrieval
    found = hybrid_search(dense, terms, corpus.chunks, corpus.terms, idf, r.top_k, r.prefetch_limit, r.rrf_k, None, filters, empty=empty)
    return ranked(found.drop("rank"), [F.desc("score"), "chunk_id"]).select("query_id", "chunk_id", "score", "rank")


def link(seeds: DataFrame, entities: DataFrame, embed: Callable[[Column], Column], settings: Settings) -> DataFrame:
    """``seeds`` (query_id, seed): entities whose name is near enough, the nearest first; none is nearer than one of that very name.

    The score bound holds after the top-k, so it never lets a sixth entity in for a weak fifth.
    """
    real = seeds.filter(F.trim("seed") != "")
    points = entities.select("canonical_id", embed(F.col("name_normalized")).alias("dense"))
    r = settings.retrieval
    near = dense_top_k(real.select("query_id", embed(F.col("seed")).alias("vector")), points, r.link_top_k, key="canonical_id", min_score=r.link_min_score)
    # different names may have one vector, so a name's own entities are found by the name
    wanted = real.select("query_id", F.lower(F.trim("seed")).alias("name"))
    own = sent(wanted).join(entities.select("canonical_id", F.lower(F.trim("name_normalized")).alias("name")), "name")
    both = near.select("query_id", "canonical_id", "score", F.lit(0).alias("own")).unionByName(own.select("query_id", "canonical_id", F.lit(1.0).alias("score"), F.lit(1).alias("own")))
    both = both.groupBy("query_id", "canonical_id").agg(F.max("score").alias("score"), F.max("own").alias("own"))
    return ranked(both, [F.desc("own"), F.desc("score"), "canonical_id"], top=r.link_top_k).drop("own")


def graph_leg(plans: DataFrame, entities: DataFrame, relates: DataFrame, mentions: DataFrame, embed: Callable[[Column], Column], settings: Settings) -> DataFrame:
    """``plans`` (query_id, template, seed_entities, hops, relation_type): the best paths of each query.

    A template without what it needs falls back to neighbors of the first seed; without that there are no paths.
    """
    r = settings.retrieval
    seeds = plans.select("query_id", F.posexplode("seed_entities").alias("at", "seed")).filter("at < 2")
    tagged = seeds.select(F.concat_ws("\u001f", "query_id", F.col("at").cast("string")).alias("query_id"), "seed")
    first = link(tagged, entities, embed, settings).filter("rank = 1").select(F.split("query_id", "\u001f").alias("k"), "canonical_id")
    ids = first.select(F.col("k")[0].alias("query_id"), F.col("k")[1].cast("int").alias("at"), "canonical_id").groupBy("query_id").pivot("at", [0, 1]).agg(F.first("canonical_id"))
    known = plans.withColumn("query_id", F.col("query_id").cast("string")).join(ids, "query_id", "left")
    one, two = F.col("0"), F.col("1")
    use = (
        F.when((F.col("template") == "entities_by_relation") & F.col("relation_type").isNotNull(), "entities_by_relation")
        .when((F.col("template") == "path_between") & one.isNotNull() & two.isNotNull(), "path_between")
        .when((F.col("template") == "co_mentioned") & one.isNotNull(), "co_mentioned")
        .when(one.isNotNull(), "neighbors")
    )
    known = materialize(known.withColumn("use", use), "plans")
    pick = lambda t, *c: known.filter(F.col("use") == t).select("query_id", *c)
    walks = {
        "neighbors": lambda: graph.neighbors(pick("neighbors", one.alias("entity_id")), relates, r.per_hop_cap, r.max_paths),
        "path_between": lambda: graph.path_between(pick("path_between", one.alias("src_id"), two.alias("dst_id")), relates),
        "entities_by_relation": lambda: graph.entities_by_relation(pick("entities_by_relation", "relation_type"), relates, r.max_paths),
        "co_mentioned": lambda: graph.co_mentioned(pick("co_mentioned", one.alias("entity_id")), mentions, r.max_paths, r.per_hop_cap),
    }
    # only the templates that some plan uses read the graph; without any, one that finds nothing
    used = {row["use"] for row in known.select("use").distinct().collect()} - {None}  # four at most
    paths = reduce(DataFrame.unionByName, [walk() for t, walk in walks.items() if t in (used or {"neighbors"})]).join(known.select("query_id", F.col("hops").alias("_h")), "query_id")
    return graph.best_paths(paths, F.least(F.col("_h"), F.lit(r.max_hops)), r.max_paths).drop("_h")


def fused(vector_hits: DataFrame, paths: DataFrame, settings: Settings) -> DataFrame:
    """Both legs by reciprocal rank: query_id, chunk_id, score, best_rank, rank."""
    r = settings.retrieval
    spoken = chunks_of_paths(paths, by_id=False)
    return fuse([vector_hits.select("query_id", "chunk_id", "rank"), spoken.select("query_id", "chunk_id", "rank")], r.rrf_k, [r.weight_vector, r.weight_graph], r.final_top_k)


#: What a failed read of a store's files is called.
LOST = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "FileNotFoundException", "UNABLE_TO_INFER_SCHEMA", "SparkFileNotFoundException")
PLAN = "strategy string, template string, seed_entities array<string>, hops int, relation_type string"
HITS = "query_id string, chunk_id string, score double, rank int"
PATHS = "query_id string, nodes array<string>, chunk_ids array<string>, hops int, score double, path_rank int"


def leg(made: Callable[[], DataFrame], shape: str, spark) -> tuple[DataFrame, bool]:
    """(a leg's rows as a table, did it work?): a store that is away, or whose files cannot be read, gives no rows and False.

    The leg runs here, so that a read that fails in the middle of its plan is known before anything is fused.
    """
    try:
        columns = [c.split()[0] for c in shape.split(", ")]
        return materialize(made().select(*columns), "leg"), True
    except (RetrievalBackendUnavailable, GraphBackendUnavailable):
        pass
    except Exception as e:
        if not any(name in str(e) for name in LOST):
            raise
    return spark.createDataFrame([], shape), False


def retriever(corpus: Callable[[], tuple[Corpus, DataFrame]], graph_tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], embed: Callable[[Column], Column], settings: Settings, empty: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """What ``answer`` asks for its context: both legs over the stores, by each question's plan.

    ``corpus`` opens the store of chunks (a corpus and its inverse frequencies), ``graph_tables`` the graph (entities, relates,
    mentions).  A plan of strategy vector or graph uses one leg.  If a leg fails, its name is in ``degraded`` of the questions that
    wanted it, and they go on with the other.  Chunks that the store no longer holds are left out of the context, one that it holds
    twice is in it once.  ``empty`` is what vectors without length score.
    """

    def vectors(asked: DataFrame) -> DataFrame:
        held, idf = corpus()
        return vector_leg(asked.filter("p.strategy <> 'graph'").select("query_id", F.col("active_query").alias("query")), held, idf, embed, settings, empty=empty)

    def paths(asked: DataFrame) -> DataFrame:
        plans = asked.filter("p.strategy <> 'vector'").select("query_id", "p.template", F.coalesce("p.seed_entities", F.array().cast("array<string>")).alias("seed_entities"), F.coalesce("p.hops", F.lit(1)).alias("hops"), "p.relation_type")
        return graph_leg(plans, *graph_tables(), embed, settings)

    def context(found: DataFrame) -> DataFrame:
        held, _ = corpus()
        sources = held.registry.groupBy("chunk_id").agg(F.min(F.struct("doc_id", "uri")).alias("s"))
        rows = found.join(held.chunks.select("chunk_id", "text"), "chunk_id").join(sources, "chunk_id", "left")
        chunk = F.struct("rank", "chunk_id", F.col("s.doc_id").alias("doc_id"), F.col("s.uri").alias("uri"), "text")
        lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))  # at most final_top_k a question
        once = F.filter("chunks", lambda c, i: ~c["rank"].eqNullSafe(F.get("chunks", i - 1)["rank"]))
        return lists.select("query_id", F.to_json(once).alias("fused"))

    def retrieve(asked: DataFrame) -> DataFrame:
        spark = asked.sparkSession
        asked = asked.withColumn("p", F.from_json("plan", PLAN))
        hits, hits_there = leg(lambda: vectors(asked), HITS, spark)
        walked, paths_there = leg(lambda: paths(asked), PATHS, spark)
        texts, texts_there = leg(lambda: context(fused(hits, walked, settings)), "query_id string, fused string", spark)
        hits_there = hits_there and texts_there
        lost = [F.when(F.col("p.strategy") != other, F.lit(name)) for name, there, other in (("vector", hits_there, "graph"), ("graph", paths_there, "vector")) if not there]
        degraded = F.array_compact(F.array(*lost)) if lost else F.array().cast("array<string>")
        return asked.select("query_id", degraded.alias("degraded")).join(texts, "query_id", "left").select("query_id", "fused", "degraded")

    return retrieve
