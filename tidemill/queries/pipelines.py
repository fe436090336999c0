"""Queries of the composite plans: parse, ingest, extract, retrieve, answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..functions.similarity import norm, score_pair, token_set_ratio
from ..operators import provenance
from ..operators.graph import upsert_documents
from ..operators.tables import replace_rows
from ..plans.extract import extract
from ..plans.ingest import delete, empty_corpus, ingest, reindex
from ..plans.models import hash_embedder
from ..plans.orchestrate import answer, results
from ..plans.retrieve import graph_leg
from ..shared import new_path
from ..sources import readers
from ..sources.files import admitted, parse
from ..sources.golden import subset
from .base import query, relates, text_id
from .base import tables as load
from .searches import NEIGHBORS


@query("SELECT 'f' || doc_id AS doc_id, text, 'text/plain' AS mime_type FROM documents WHERE trim(text) <> ''")
def S2_S3_S4_S5_parse_files(spark, d):
    (docs,) = load(spark, d, "documents")
    files = docs.select(text_id("f", "doc_id").alias("doc_id"), F.concat(text_id("mem:", "doc_id"), F.lit(".txt")).alias("uri"), F.encode("text", "UTF-8").alias("content"))
    ok, _ = admitted(files.withColumn("length", F.length("content")))
    parsed, _ = parse(ok)
    return parsed.select("doc_id", "text", "mime_type")


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE source END AS uri FROM documents
 UNION ALL SELECT doc_id, 'labelled' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def K8_merge_documents(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    return upsert_documents(docs.select("doc_id", F.col("source").alias("uri")), labels.select("doc_id", F.lit("labelled").alias("uri")))


@query(r"""SELECT sha256(text) AS sha256, CAST(0 AS INTEGER) AS first, CAST(max(length(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g'))) AS INTEGER) AS last, 'INDEXED' AS status
 FROM documents WHERE text <> '' GROUP BY text""")
def P1_ingest(spark, d):
    (docs,) = load(spark, d, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_id("doc:", "doc_id").alias("uri"), "text", F.lit("text/plain").alias("mime_type"), F.sha2("text", 256).alias("sha256"))
    corpus = ingest(empty_corpus(spark), rows, hash_embedder(), Settings(), F.timestamp_seconds(F.lit(0)))
    places = corpus.registry.select("doc_id", "char_start", "char_end").unionByName(corpus.repeats.select("doc_id", "char_start", "char_end"))
    spans = places.groupBy("doc_id").agg(F.min("char_start").alias("first"), F.max("char_end").alias("last"))
    texts = corpus.ledger.filter(F.col("sha256") != F.sha2(F.lit(""), 256)).join(spans, "doc_id", "left")  # control characters alone give no chunk
    return texts.select("sha256", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("last", F.lit(0)).alias("last"), "status")


def first_letters(role, request):
    """A model that finds each chunk's first four characters, and a mention beyond its end."""
    mentions = [{"chunk_id": c["chunk_id"], "surface": c["text"][:4], "type": "ORG", "char_start": 0, "char_end": end, "confidence": 0.5} for c in request["chunks"] for end in (4, len(c["text"]) + 1)]
    return {"value": {"mentions": mentions, "relations": []}}


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, substr(text, 1, 4) AS surface, CAST(4 AS INTEGER) AS char_end FROM documents WHERE length(text) >= 4")
def P4_extract(spark, d):
    (docs,) = load(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.floor(F.col("doc_id") / 100).alias("doc"), F.lit(0).alias("ord"))
    mentions, _, _ = extract(chunks, first_letters, group="doc")
    return mentions.select("chunk_id", "surface", "char_end")


@query(f"""{NEIGHBORS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS pr FROM paths)
 SELECT CAST(query_id AS VARCHAR) AS query_id, nodes, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr) AS INTEGER) AS path_rank FROM p WHERE hops <= 1""")
def P9_P10_F9_graph_leg(spark, d):
    (supplier,) = load(spark, d, "supplier")
    entities = supplier.select(text_id("S", "s_suppkey").alias("canonical_id"), F.col("s_name").alias("name_normalized"))
    plans = supplier.filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("query_id"), F.lit("neighbors").alias("template"), F.array("s_name").alias("seed_entities"), F.lit(1).alias("hops"), F.lit(None).cast("string").alias("relation_type"))
    none = spark.createDataFrame([], "chunk_id string, entity_id string, confidence double, char_start int")
    return graph_leg(plans, entities, relates(spark, d), none, hash_embedder(), Settings()).select("query_id", "nodes", "path_rank")


def even_chunks(role, request):
    """A model for which chunks of even number are relevant."""
    if role == "router":
        value = {"strategy": ("vector", "graph", "hybrid")[len(request["question"]) % 3], "query": "again"}
    elif role == "grader":
        value = {"grades": [{"chunk_id": c["chunk_id"], "relevant": int(c["chunk_id"]) % 2 == 0} for c in request["chunks"]]}
    elif role == "synth":
        value = {"text": "because", "citations": [{"chunk_id": c["chunk_id"]} for c in request["chunks"]], "confidence": 0.9}
    else:
        value = {"score": 0.9}
    return {"value": value, "prompt_tokens": 10, "completion_tokens": 5, "latency_ms": 3}


@query("""SELECT CAST(item_id AS VARCHAR) AS query_id, item_id % 2 = 1 AS refused, (['vector', 'graph', 'hybrid'])[length(text) % 3 + 1] AS strategy,
 CASE WHEN item_id % 2 = 0 THEN [CAST(item_id AS VARCHAR), CAST(item_id + 2 AS VARCHAR)] ELSE [CAST(item_id + 1 AS VARCHAR)] END AS citations, CAST(CASE WHEN item_id % 2 = 0 THEN 4 ELSE 8 END AS INTEGER) AS llm_calls FROM benchmark""")
def N1_N13_state_machine(spark, d):
    (bench,) = load(spark, d, "benchmark")

    def retrieve(asked):
        chunk = lambda n: F.struct((F.col("query_id").cast("long") + n).cast("string").alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit("u").alias("uri"), F.lit("t").alias("text"))
        return asked.select("query_id", F.to_json(F.array(*[chunk(n) for n in range(3)])).alias("fused"), F.array().cast("array<string>").alias("degraded"))

    found = results(answer(bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), even_chunks, retrieve))
    return found.select("query_id", "refused", "strategy", "citations", F.col("spent.llm_calls").alias("llm_calls"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 3")
def T8_T10_first_items(spark, d):
    (orders,) = load(spark, d, "orders")
    return subset(orders.withColumn("pos", F.col("o_orderkey")), 3).select("o_orderkey", "o_custkey").orderBy("o_orderkey")


@query("""SELECT n_nationkey AS a, CAST(1 AS DOUBLE) AS same, round(greatest(1 - CAST(length(n_name) AS DOUBLE) / (length(n_name) + 7), 1 - CAST(length(n_name) + 1 AS DOUBLE) / (length(n_name) + 13)), 9) AS longer FROM nation""")
def X12_token_set(spark, d):
    (nation,) = load(spark, d, "nation")
    ratio = lambda x, y: F.round(token_set_ratio(x, y), 9)
    name = F.col("n_name")
    return nation.select(F.col("n_nationkey").alias("a"), ratio(F.concat(name, F.lit(" the of")), F.concat(F.lit("of "), name, F.lit(" the the"))).alias("same"), ratio(F.concat(F.lit("shared "), F.regexp_replace(name, ".", "q")), F.concat(F.lit("shared "), F.regexp_replace(name, ".", "z"))).alias("longer"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_regionkey <> b.n_regionkey THEN 0 ELSE round(0.3 * jaro_winkler_similarity(a.n_name, b.n_name) + 0.3 * CAST(a.n_name = b.n_name AS INT) + 0.4 * 0.5 + CASE WHEN a.n_name <> b.n_name THEN
  0.3 * CAST(2 * (length('NATION_') + CASE WHEN length(a.n_name) = 8 AND length(b.n_name) = 9 THEN CAST(contains(substr(b.n_name, 8), substr(a.n_name, 8)) AS INT) WHEN length(a.n_name) = 9 AND length(b.n_name) = 8 THEN CAST(contains(substr(a.n_name, 8), substr(b.n_name, 8)) AS INT)
   WHEN length(a.n_name) = 9 AND length(b.n_name) = 9 THEN CASE WHEN substr(a.n_name, 8, 1) = substr(b.n_name, 8, 1) OR substr(a.n_name, 9, 1) = substr(b.n_name, 9, 1) OR substr(a.n_name, 8, 1) = substr(b.n_name, 9, 1) OR substr(a.n_name, 9, 1) = substr(b.n_name, 8, 1) THEN 1 ELSE 0 END ELSE 0 END) AS DOUBLE) / (length(a.n_name) + length(b.n_name)) ELSE 0 END, 6) END AS score FROM nation a, nation b""")
def X13_pair_scores(spark, d):
    from ..config import Resolution

    (nation,) = load(spark, d, "nation")
    a = nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), F.col("n_regionkey").alias("s"))
    b = nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), F.col("n_regionkey").alias("t"))
    return a.crossJoin(b).select("a", "b", F.round(score_pair(F.col("x"), F.col("y"), F.col("s"), F.col("t"), F.lit(0.5), Resolution()), 6).alias("score"))


# -- the corpus over short documents, many of which share a paragraph --------------------------------------------------

SHORT = "s AS (SELECT 'C' || c_custkey AS doc_id, 'A ' || lower(c_mktsegment) || ' customer of nation ' || c_nationkey AS text FROM customer)"


def short_corpus(spark, d):
    (customer,) = load(spark, d, "customer")
    text = F.concat(F.lit("A "), F.lower("c_mktsegment"), F.lit(" customer of nation "), F.col("c_nationkey").cast("string"))
    rows = customer.select(text_id("C", "c_custkey").alias("doc_id"), text_id("mem:", "c_custkey").alias("uri"), text.alias("text"), F.lit("text/plain").alias("mime_type"), F.sha2("c_name", 256).alias("sha256"))
    return ingest(empty_corpus(spark), rows, hash_embedder(), Settings(), F.timestamp_seconds(F.lit(0)))


@query(f"WITH {SHORT} SELECT text, count(*) AS n_sources, min(doc_id) AS first_doc, CAST(length(text) AS INTEGER) AS char_end FROM s GROUP BY text")
def P2_P12_K4_reindex(spark, d):
    """Every chunk's sources from the registry alone, and no orphan."""
    corpus = short_corpus(spark, d)
    chunks, orphans = reindex(corpus)
    per_chunk = chunks.select("text", F.size("sources").cast("long").alias("n_sources"), F.col("doc_ids")[0].alias("first_doc"), F.element_at("sources", 1)["char_end"].alias("char_end"))
    return per_chunk.unionByName(orphans.select(F.col("chunk_id").alias("text"), F.lit(0).cast("long").alias("n_sources"), F.lit("").alias("first_doc"), F.lit(0).alias("char_end")))


@query(f"""WITH {SHORT}, alone AS (SELECT min(doc_id) AS doc_id FROM s WHERE text IN (SELECT text FROM s GROUP BY text HAVING count(*) = 1)), gone AS (SELECT 'C5' AS doc_id UNION SELECT doc_id FROM alone WHERE doc_id IS NOT NULL)
 SELECT text, count(*) AS n_sources, (SELECT count(*) FROM gone) AS deleting FROM s WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY text""")
def P3_K14_delete(spark, d):
    """Take out one document that shares its chunk and one, if there is any, that holds its chunk alone."""
    corpus = short_corpus(spark, d)
    only = provenance.only_owned(corpus.registry, corpus.ledger).agg(F.min("doc_id").alias("doc_id")).first()["doc_id"]
    for doc in sorted({"C5", *([only] if only else [])}):
        corpus = delete(corpus, doc, F.timestamp_seconds(F.lit(1)))
    n = corpus.ledger.filter("status = 'DELETING'").agg(F.count("*").alias("deleting"))
    counts = corpus.chunks.join(corpus.registry, "chunk_id").groupBy("text").agg(F.count("*").alias("n_sources"))
    return counts.join(F.broadcast(n))


@query("SELECT fmt, n_nationkey, n_name FROM nation, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS fmt)")
def S16_formats(spark, d):
    """A table written in each format and read again with its schema."""
    (nation,) = load(spark, d, "nation")
    rows, found = nation.select("n_nationkey", "n_name"), None
    for fmt in ("csv", "json", "orc", "parquet"):
        path = new_path(spark, fmt)
        rows.write.format(fmt).save(path)
        got = readers.read(spark, path, fmt, "n_nationkey int, n_name string").withColumn("fmt", F.lit(fmt))
        found = got if found is None else found.unionByName(got)
    return found


@query("SELECT doc_id, CAST(64 AS INTEGER) AS n, round(CASE WHEN trim(text) = '' THEN 0 ELSE 1 END, 4) AS length FROM documents")
def X18_embedded(spark, d):
    (docs,) = load(spark, d, "documents")
    rows = docs.select("doc_id", hash_embedder()(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size("v").alias("n"), F.round(norm(F.col("v")), 4).alias("length"))


@query("""SELECT 'C' || c_custkey AS canonical_id, CASE WHEN c_custkey % 10 = 0 THEN 'new ' || c_name ELSE c_name END AS name, CAST(CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS INTEGER) AS width FROM customer""")
def K6_upsert_entities_with_vectors(spark, d):
    (customer,) = load(spark, d, "customer")
    row = lambda name, vector: customer.select(text_id("C", "c_custkey").alias("canonical_id"), name.alias("name"), F.array(*[F.lit(x) for x in vector]).alias("vector"), "c_custkey")
    old, new = row(F.col("c_name"), [0.5]), row(F.concat(F.lit("new "), "c_name"), [0.5, 0.5]).filter("c_custkey % 10 = 0")
    both = replace_rows(old.drop("c_custkey"), new.drop("c_custkey"), ["canonical_id"], ["name"])
    return both.select("canonical_id", "name", F.size("vector").alias("width"))
