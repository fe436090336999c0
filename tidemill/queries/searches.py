"""Queries of search, fusion, ranking and graph traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import cosine
from ..functions.text import tokens
from ..operators import graph, postings, search
from ..operators.fusion import chunks_of_paths, fuse, ranked
from ..operators.numbering import positions
from .base import MENTIONS, RELATES, UNDIRECTED, mentions, query, relates, text_id
from .base import tables as load


def points(spark, d):
    (e,) = load(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"), "label")


def vector_queries(spark, d):
    """Every vector whose id is divisible by 50 is a query against all of them."""
    return points(spark, d).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("dense").alias("vector"))


COS = "list_cosine_similarity(list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE)), list_transform({1}.embedding, lambda x: CAST(x AS DOUBLE)))"
DENSE = f"""SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, p.label, {COS.format('q', 'p')} AS score FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0"""


@query(f"""SELECT query_id, chunk_id, round(score, 9) AS score, CAST(r AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM ({DENSE})) WHERE r <= 50""")
def T1_J15_X10_dense_top_k(spark, d):
    found = search.dense_top_k(vector_queries(spark, d), points(spark, d), 50)
    return found.withColumn("score", F.round("score", 9))


@query(f"""SELECT query_id, chunk_id, round(score, 9) AS score, CAST(r AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM ({DENSE} WHERE p.label IN (1, 2))) WHERE r <= 5 AND score >= 0.3""")
def F2_F4_filter_before_top_k(spark, d):
    found = search.dense_top_k(vector_queries(spark, d), points(spark, d), 5, {"label": [1, 2]}, min_score=0.3)
    return found.withColumn("score", F.round("score", 9))


@query(f"""SELECT query_id, chunk_id, CAST(r AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM (
  SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, {COS.format('q', 'p')} AS score FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0 AND q.label = p.label)) WHERE r <= 25""")
def F3_T5_top_k_of_same_type(spark, d):
    q = vector_queries(spark, d).join(points(spark, d).select(F.col("chunk_id").alias("query_id"), "label"), "query_id")
    return search.dense_top_k(q, points(spark, d), 25, same="label").select("query_id", "chunk_id", "rank")


def chunks(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), "text", "lang")


def question_terms(spark, d):
    (bench,) = load(spark, d, "benchmark")
    return search.term_frequencies(bench.select(F.col("item_id").alias("query_id"), "text"), "query_id")


TERMS = r"""terms AS (
  SELECT chunk_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id AS chunk_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL
), q AS (
  SELECT query_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL
), idf AS (
  SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM terms GROUP BY term
), sparse AS (
  SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(sum(q.tf * t.tf * idf), 9) AS score FROM q JOIN terms t USING (term) JOIN idf USING (term) GROUP BY ALL)) WHERE rank <= 50
)"""


def indexed(spark, d):
    """(terms, inverse frequencies, index) of all documents, which are cut into terms once."""
    (docs,) = load(spark, d, "documents")
    terms = search.term_frequencies(chunks(spark, d))
    index = postings.build(terms, dealt=True)
    return terms, postings.inverse_frequencies(index, docs), index


def idf(spark, d):
    (docs,) = load(spark, d, "documents")
    return search.inverse_frequencies(search.term_frequencies(chunks(spark, d)), docs)


@query(f"WITH {TERMS} SELECT term, df, round(idf, 9) AS idf FROM idf")
def A27_idf(spark, d):
    return idf(spark, d).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {TERMS} SELECT chunk_id, term, tf FROM terms")
def A12_X19_term_frequencies(spark, d):
    return search.term_frequencies(chunks(spark, d))


@query(f"WITH {TERMS} SELECT query_id, chunk_id, round(score, 4) AS score FROM sparse")
def T2_J16_sparse_top_k(spark, d):
    terms, weights, index = indexed(spark, d)
    found = search.sparse_top_k(question_terms(spark, d), terms, weights, 50, index=index)
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"))


@query(f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({DENSE})),
 l AS (SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(p.vec_id - q.vec_id - 3), p.vec_id) AS rank FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0 AND q.label = p.label),
 u AS (SELECT query_id, chunk_id, rank, 1.0 AS w FROM v WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, rank, 0.5 FROM l WHERE rank <= 50)
 SELECT query_id, chunk_id, round(score, 9) AS score, CAST(best_rank AS INTEGER) AS best_rank, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM (SELECT query_id, chunk_id, sum(CAST(w AS DOUBLE) / (60 + rank)) AS score, min(rank) AS best_rank FROM u GROUP BY ALL)) WHERE rank <= 10""")
def A1_P11_W2_T4_rank_fusion(spark, d):
    dense = search.dense_top_k(vector_queries(spark, d), points(spark, d), 50)
    # of a label's ids in order, the 50 nearest to an id and three are among the 50 to either side of it and the next three
    ids = points(spark, d).filter("label is not null and chunk_id is not null").groupBy("label", "chunk_id").agg(F.count("*").alias("n"))
    nth = positions(ids, ["chunk_id"], ["label"], "nth")
    asked = nth.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "label", F.col("n").alias("times"), F.explode(F.sequence(F.col("nth") - 50, F.col("nth") + 53)).alias("nth"))
    pairs = asked.join(nth, ["label", "nth"]).select("query_id", "chunk_id", F.explode(F.array_repeat(F.lit(0), F.least(F.col("n") * F.col("times"), F.lit(50)).cast("int"))))
    near = ranked(pairs, [F.abs(F.col("chunk_id") - F.col("query_id") - 3), "chunk_id"], top=50)
    fused = fuse([dense, near], 60, [1.0, 0.5], 10)
    return fused.withColumn("score", F.round("score", 9))


@query(rf"""WITH {TERMS}, emb AS (SELECT * FROM embeddings JOIN documents ON vec_id = doc_id), bq AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
 dn AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
   SELECT b.query_id, p.vec_id AS chunk_id, {COS.format('b', 'p')} AS score FROM bq b, emb p WHERE p.lang IN ('en', 'de'))) WHERE rank <= 50),
 sp AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
   SELECT query_id, chunk_id, round(sum(q.tf * t.tf * idf), 9) AS score FROM q JOIN terms t USING (term) JOIN idf USING (term) WHERE chunk_id IN (SELECT vec_id FROM emb WHERE lang IN ('en', 'de')) GROUP BY ALL)) WHERE rank <= 50),
 u AS (SELECT * FROM dn UNION ALL SELECT * FROM sp)
 SELECT query_id, chunk_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS score, min(rank) AS best FROM u GROUP BY ALL)) WHERE rank <= 20""")
def P7_P8_hybrid_search(spark, d):
    docs, bench = load(spark, d, "documents", "benchmark")
    pts = points(spark, d).join(docs.select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id")
    queries = points(spark, d).join(bench.select(F.col("item_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), F.col("dense").alias("vector"))
    terms, weights, index = indexed(spark, d)
    found = search.hybrid_search(queries, question_terms(spark, d), pts, terms, weights, filters={"lang": ["en", "de"]}, index=index)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("""SELECT label AS query_id, vec_id AS chunk_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS INTEGER) AS rank FROM embeddings""")
def W1_renumber(spark, d):
    nth = positions(points(spark, d).select("label", "chunk_id"), [F.desc("chunk_id")], ["label"], "nth")
    return nth.select(F.col("label").alias("query_id"), "chunk_id", (F.col("nth") + 1).cast("int").alias("rank"))


# -- graph ----------------------------------------------------------------------------------------------------------


def starts(spark, d):
    (supplier,) = load(spark, d, "supplier")
    return supplier.filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("query_id"), text_id("S", "s_suppkey").alias("entity_id"))


NEIGHBORS = f"""WITH {RELATES}, {UNDIRECTED},
 one AS (SELECT s_suppkey AS query_id, a AS start, b AS n1, confidence AS c1, chunk_id AS k1, row_number() OVER (PARTITION BY s_suppkey ORDER BY confidence DESC, b, chunk_id, type, doc_id) AS r1
   FROM supplier JOIN und ON a = 'S' || s_suppkey WHERE s_suppkey % 50 = 0 QUALIFY r1 <= 25),
 two AS (SELECT query_id, n1, b AS n2, confidence AS c2, chunk_id AS k2, row_number() OVER (PARTITION BY query_id, n1 ORDER BY confidence DESC, b, chunk_id, type, doc_id) AS r2
   FROM (SELECT DISTINCT query_id, start, n1 FROM one) JOIN und ON a = n1 WHERE b <> start QUALIFY r2 <= 25),
 rows AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r1, r2 NULLS FIRST) AS row FROM one LEFT JOIN two USING (query_id, n1) QUALIFY row <= 40),
 paths AS (SELECT query_id, min(row) * 2 AS place, [start, n1] AS nodes, [k1] AS chunk_ids, 1 AS hops, arg_min(c1, row) AS score FROM rows GROUP BY query_id, start, n1, k1
   UNION ALL SELECT query_id, row * 2 + 1, [start, n1, n2], list_sort(list_distinct([k1, k2])), 2, (c1 + c2) / 2 FROM rows WHERE n2 IS NOT NULL)"""


@query(f"{NEIGHBORS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS path_rank, nodes, chunk_ids, hops, round(score, 9) AS score FROM paths")
def G1_J9_J10_J11_W4_A9_neighbors(spark, d):
    return graph.traverse("neighbors", starts(spark, d), relates(spark, d), None).withColumn("score", F.round("score", 9))


@query(f"""{NEIGHBORS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS pr FROM paths)
 SELECT query_id, nodes, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr) AS INTEGER) AS path_rank FROM p WHERE hops <= 1""")
def F8_T6_best_paths(spark, d):
    paths = graph.neighbors(starts(spark, d), relates(spark, d))
    return graph.best_paths(paths, 1).select("query_id", "nodes", "path_rank")


@query(f"""{NEIGHBORS}, c AS (SELECT query_id, unnest(chunk_ids) AS chunk_id, score FROM paths)
 SELECT query_id, chunk_id, round(m, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m DESC, chunk_id) AS INTEGER) AS rank FROM (SELECT query_id, chunk_id, max(score) AS m FROM c GROUP BY ALL)""")
def A2_W3_chunks_of_paths(spark, d):
    paths = graph.neighbors(starts(spark, d), relates(spark, d))
    return chunks_of_paths(paths).withColumn("score", F.round("score", 9))


@query(f"""WITH {RELATES}, {UNDIRECTED}, e AS (SELECT c_custkey AS query_id, 'S' || (c_custkey % (SELECT count(*) FROM supplier)) AS src, 'P' || c_custkey AS dst FROM customer WHERE c_custkey % 50 = 0),
 one AS (SELECT query_id, [src, dst] AS nodes, [chunk_id] AS chunk_ids, 1 AS hops, confidence AS score FROM e JOIN und ON a = src AND b = dst),
 best AS (SELECT a, b, confidence, chunk_id FROM und QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY confidence DESC, chunk_id) = 1),
 two AS (SELECT query_id, [src, x.b, dst] AS nodes, list_sort(list_distinct([x.chunk_id, y.chunk_id])) AS chunk_ids, 2 AS hops, (x.confidence + y.confidence) / 2 AS score
   FROM e JOIN best x ON x.a = src JOIN best y ON y.a = x.b AND y.b = dst WHERE query_id NOT IN (SELECT query_id FROM one) AND x.b NOT IN (src, dst))
 SELECT query_id, nodes, chunk_ids, hops, round(score, 9) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hops, score DESC, nodes, chunk_ids) = 1""")
def G2_path_between(spark, d):
    customer, supplier = load(spark, d, "customer", "supplier")
    n = supplier.count()
    pairs = customer.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("S"), (F.col("c_custkey") % n).cast("string")).alias("src_id"), text_id("P", "c_custkey").alias("dst_id"))
    return graph.traverse("path_between", pairs, relates(spark, d), None).select("query_id", "nodes", "chunk_ids", "hops", F.round("score", 9).alias("score"))


@query(f"""WITH {RELATES} SELECT type AS query_id, CAST(r AS INTEGER) AS path_rank, [src_id, dst_id] AS nodes, round(confidence, 9) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, src_id, dst_id, chunk_id, doc_id) AS r FROM relates) WHERE r <= 40""")
def G3_J12_entities_by_relation(spark, d):
    rows = relates(spark, d)
    types = rows.select(F.col("type").alias("query_id"), F.col("type").alias("relation_type")).distinct()
    return graph.traverse("entities_by_relation", types, rows, None).select("query_id", "path_rank", "nodes", F.round("score", 9).alias("score"))


@query(f"""WITH {MENTIONS}, s AS (SELECT c_custkey AS query_id, 'C' || c_custkey AS seed FROM customer WHERE c_custkey % 50 = 0),
 c AS (SELECT DISTINCT query_id, seed, chunk_id FROM (SELECT query_id, seed, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, chunk_id, char_start) AS r FROM s JOIN mentions ON entity_id = seed) WHERE r <= 25),
 o AS (SELECT DISTINCT query_id, b, chunk_id, confidence FROM (SELECT query_id, entity_id AS b, c.chunk_id, confidence, row_number() OVER (PARTITION BY query_id, c.chunk_id ORDER BY confidence DESC, entity_id, char_start) AS r
   FROM c JOIN mentions m ON m.chunk_id = c.chunk_id WHERE entity_id <> seed) WHERE r <= 25)
 SELECT query_id, CAST(r AS INTEGER) AS path_rank, b AS node, chunk_id, round(confidence, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, b, chunk_id) AS r FROM o) WHERE r <= 40""")
def G4_U6_co_mentioned(spark, d):
    (customer,) = load(spark, d, "customer")
    seeds = customer.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), text_id("C", "c_custkey").alias("entity_id"))
    found = graph.traverse("co_mentioned", seeds, None, mentions(spark, d))
    return found.select("query_id", "path_rank", F.col("nodes")[0].alias("node"), F.col("chunk_ids")[0].alias("chunk_id"), F.round("score", 9).alias("score"))


@query(f"""WITH {RELATES}, e AS (SELECT chunk_id, src_id || '|' || dst_id || '|' || type || '|' || chunk_id || '|' || doc_id AS edge, unnest(list_distinct([src_id, dst_id])) AS a FROM relates),
 q AS (SELECT o_custkey AS query_id, 'o' || o_orderkey AS chunk_id FROM orders WHERE o_custkey % 50 = 0)
 SELECT query_id, CAST(r AS INTEGER) AS path_rank, a AS node, CAST(degree AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY degree DESC, a) AS r FROM (
  SELECT query_id, a, count(DISTINCT edge) AS degree FROM q JOIN e USING (chunk_id) GROUP BY ALL)) WHERE r <= 40""")
def G5_A8_top_entities_for_chunks(spark, d):
    (orders,) = load(spark, d, "orders")
    asked = orders.filter("o_custkey % 50 = 0").select(F.col("o_custkey").alias("query_id"), text_id("o", "o_orderkey").alias("chunk_id"))
    found = graph.traverse("top_entities_for_chunks", asked, relates(spark, d), None)
    return found.select("query_id", "path_rank", F.col("nodes")[0].alias("node"), "score")


@query(f"SELECT q.vec_id AS a, p.vec_id AS b, round({COS.format('q', 'p')}, 9) AS score FROM embeddings q JOIN embeddings p ON p.vec_id = q.vec_id + 1")
def X10_cosine(spark, d):
    p = points(spark, d)
    q = p.select(F.col("chunk_id").alias("query_id"), F.col("dense").alias("vector"))
    both = q.join(p, F.col("chunk_id") == F.col("query_id") + 1)
    return both.select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b"), F.round(cosine(F.col("vector"), F.col("dense")), 9).alias("score"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS INTEGER) AS n FROM documents")
def X19_tokens(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", F.size(tokens(F.col("text"))).alias("n"))
