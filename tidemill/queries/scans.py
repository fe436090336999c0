"""Queries of scans, mutations, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Limits, Resolution, Trail
from ..functions import scalars
from ..functions.identity import chunk_id, document_id
from ..functions.similarity import band
from ..operators import ledger as L
from ..operators import provenance, tables, trail
from ..operators.chunking import batched, page_of
from ..operators.graph import upsert_entities, upsert_mentions, upsert_relations
from ..schemas import STATUSES
from .base import MENTIONS, NORMAL, RELATES, mentions, query, relates, text_id, uuid_sql
from .base import tables as load

def epoch():
    return F.timestamp_seconds(F.lit(0))


def registry(spark, folder):
    """Documents that share a text share a chunk."""
    (docs,) = load(spark, folder, "documents")
    return docs.select(F.sha2("text", 256).alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc:"), "doc_id").alias("uri"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), epoch().alias("ingested_at"))


REGISTRY = "registry AS (SELECT sha256(text) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS char_end FROM documents)"


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def S8_lookup_by_ids(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    return tables.lookup(docs.select("doc_id", "source", "n_chars"), labels, "doc_id")


@query(f"WITH {REGISTRY} SELECT chunk_id, any_value(text) AS text, list(r.doc_id ORDER BY r.doc_id) AS docs FROM registry r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.doc_id GROUP BY chunk_id")
def S9_chunks_with_sources(spark, d):
    (docs,) = load(spark, d, "documents")
    chunks = docs.select(F.sha2("text", 256).alias("chunk_id"), "text").dropDuplicates(["chunk_id"])
    found = provenance.chunks_of(chunks, chunks, registry(spark, d))
    return found.select("chunk_id", "text", F.transform("sources", lambda s: s["doc_id"]).alias("docs"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def S10_row_by_key(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.filter("doc_id = 7").select("doc_id", "lang", "source", "n_chars")


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = 7 AND ts <= TIMESTAMP '2024-01-03' AND ts >= TIMESTAMP '2024-01-02'")
def S13_events_of_one_id(spark, d):
    (events,) = load(spark, d, "events")
    return trail.in_window(events, 7, F.lit("2024-01-03").cast("timestamp_ntz"), Trail(), "user_id", "ts").select("event_id", "ts", "event_type")


@query("""SELECT 't' || user_id AS trace_id, 's' || event_id AS span_id, event_type AS message, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       date_trunc('millisecond', ts) AS at, CAST(user_id AS VARCHAR) AS user_id FROM events""")
def S14_spans_of_traces(spark, d):
    (events,) = load(spark, d, "events")
    ns = F.concat(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("000000"))
    attribute = F.array(F.struct(F.lit("user_id").alias("key"), F.struct(F.col("user_id").cast("string").alias("stringValue")).alias("value")))
    span = F.struct(text_id("s", "event_id").alias("spanId"), F.col("event_type").alias("name"), ns.alias("startTimeUnixNano"), attribute.alias("attributes"), F.struct(F.when(F.col("event_type") == "error", "2").otherwise("1").alias("code")).alias("status"))
    # one trace for each user and day, so that no trace grows with the table
    bodies = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(span).alias("spans"))
    bodies = bodies.select(text_id("t", "user_id").alias("trace_id"), F.to_json(F.struct(F.array(F.struct(F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))).alias("body"))
    return trail.span_events(bodies).select("trace_id", "span_id", "message", "level", F.col("at").cast("timestamp_ntz").alias("at"), F.element_at("attributes", "user_id").alias("user_id"))


def uploads(spark, folder):
    (docs,) = load(spark, folder, "documents")
    return docs.select(document_id(F.col("text").cast("binary")).alias("doc_id"), text_id("doc:", "doc_id").alias("uri"), F.sha2("text", 256).alias("sha256"), F.lit("text/plain").alias("mime_type"))


def old_ledger(spark, folder):
    """Labelled documents are already known."""
    docs, labels = load(spark, folder, "documents", "labels")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["text"])
    sha = F.sha2("text", 256)
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.instr(F.lit("0123456789abcdef"), F.substring(sha, 1, 1)) - 1) % 8 + 1)
    return known.select(F.concat(F.lit("old"), F.substring(sha, 1, 12)).alias("doc_id"), text_id("doc:", "doc_id").alias("uri"), sha.alias("sha256"), F.lit("text/plain").alias("mime_type"), status.alias("status"), F.lit(None).cast("string").alias("error_code"), F.lit(1).alias("attempts"), F.lit(1).cast("long").alias("corpus_version"), epoch().alias("created_at"), epoch().alias("updated_at"))


@query("SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1")
def K1_register_once(spark, d):
    ledger, marked = L.register(old_ledger(spark, d), uploads(spark, d), epoch())
    return ledger.join(marked.groupBy("sha256").agg(F.count("*").alias("n")), "sha256").select("sha256", "n")


@query(f"WITH {REGISTRY} SELECT chunk_id, doc_id, char_end FROM registry")
def K2_add_sources(spark, d):
    rows = registry(spark, d)
    again = rows.unionByName(rows)
    return provenance.register_sources(rows.filter("doc_id < '5'"), again).select("chunk_id", "doc_id", "char_end")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE lang END AS lang FROM documents")
def K3_replace_rows(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    rows = labels.select("doc_id", F.lit("new").alias("lang"), "quality")
    return tables.replace_rows(docs.select("doc_id", "lang"), rows, ["doc_id"], [F.desc("quality")])


@query(f"WITH {REGISTRY} SELECT chunk_id, count(*) AS n_sources, list(doc_id ORDER BY doc_id) AS doc_ids FROM registry GROUP BY chunk_id")
def K4_set_sources(spark, d):
    rows = registry(spark, d)
    ids = rows.select("chunk_id").distinct()
    chunks, _ = provenance.project(ids, rows, ids)
    return chunks.select("chunk_id", F.size("sources").cast("long").alias("n_sources"), "doc_ids")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def K5_delete_by_ids(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    return tables.delete_ids(docs.select("doc_id", "source"), labels, "doc_id")


@query("""SELECT 'C' || c_custkey AS canonical_id, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name, CASE WHEN s_suppkey IS NULL THEN 'old' ELSE 'kept' END AS created_at
       FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
       UNION ALL SELECT 'C' || s_suppkey, s_name, 'new' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""")
def K7_merge_entities(spark, d):
    customer, supplier = load(spark, d, "customer", "supplier")
    old = customer.select(text_id("C", "c_custkey").alias("canonical_id"), F.col("c_name").alias("name"), F.lit("old").alias("created_at"))
    new = supplier.select(text_id("C", "s_suppkey").alias("canonical_id"), F.col("s_name").alias("name"))
    merged = upsert_entities(old, new, F.lit("new"))
    hit = new.select("canonical_id", F.lit(True).alias("hit"))
    # a row that existed keeps its creation time whatever the batch says
    return merged.join(hit, "canonical_id", "left").select("canonical_id", "name", F.when(F.col("hit") & (F.col("created_at") == "old"), "kept").otherwise(F.col("created_at")).alias("created_at"))


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY first_key) - 1 AS ord, o_orderstatus, first_key
       FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_key FROM orders GROUP BY ALL)""")
def K9_ord_of_distinct_chunks(spark, d):
    (orders,) = load(spark, d, "orders")
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("chunk_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("first_key"))
    return provenance.renumbered(rows).select(F.col("doc_id").alias("o_custkey"), F.col("ord").cast("long").alias("ord"), F.col("chunk_id").alias("o_orderstatus"), "first_key")


@query(f"WITH {RELATES} SELECT type, count(*) AS n, round(sum(confidence), 4) AS total FROM relates GROUP BY type")
def K10_merge_relations(spark, d):
    rows = relates(spark, d)
    old = rows.filter("type = 'SUPPLIES_A'").withColumn("confidence", F.lit(0.0))
    return upsert_relations(old, rows).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query(f"WITH {MENTIONS} SELECT substr(entity_id, 1, 1) AS kind, count(*) AS n, round(sum(confidence), 4) AS total FROM mentions GROUP BY 1")
def K11_merge_mentions(spark, d):
    rows = mentions(spark, d)
    merged = upsert_mentions(rows.filter("char_start = 0"), rows)
    return merged.groupBy(F.substring("entity_id", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query("""SELECT o_orderkey AS alias_id, o_custkey AS canonical_id, CASE WHEN o_orderstatus = 'F' THEN 'then' ELSE 'now' END AS decided_at FROM orders""")
def K12_add_aliases(spark, d):
    from ..operators.graph import add_aliases

    (orders,) = load(spark, d, "orders")
    rows = orders.select(F.col("o_orderkey").alias("alias_id"), F.col("o_custkey").alias("canonical_id"), F.lit(1.0).alias("score"), F.lit("cluster").alias("method"))
    old = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("alias_id"), F.col("o_custkey").alias("canonical_id"), F.lit(0.5).alias("score"), F.lit("cluster").alias("method"), F.lit("then").alias("decided_at"))
    return add_aliases(old, rows, F.lit("now")).select("alias_id", "canonical_id", "decided_at")


@query("""WITH held AS (SELECT DISTINCT 'S' || l_suppkey AS doc_id, 'P' || l_partkey AS chunk_id FROM lineitem),
 dead AS (SELECT 'S' || s_suppkey AS doc_id FROM supplier WHERE s_acctbal < 0),
 gone AS (SELECT chunk_id FROM held GROUP BY chunk_id HAVING bool_and(doc_id IN (SELECT doc_id FROM dead)))
 SELECT 'documents' AS name, count(*) AS n FROM supplier WHERE 'S' || s_suppkey NOT IN (SELECT doc_id FROM dead)
 UNION ALL SELECT 'has_chunk', count(*) FROM held WHERE doc_id NOT IN (SELECT doc_id FROM dead)
 UNION ALL SELECT 'chunks', count(*) FROM part WHERE 'P' || p_partkey NOT IN (SELECT chunk_id FROM gone)
 UNION ALL SELECT 'mentions', count(*) FROM held WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)""")
def K13_delete_documents(spark, d):
    from functools import reduce

    from ..operators.graph import delete_document

    supplier, part, lines = load(spark, d, "supplier", "part", "lineitem")
    held = lines.select(text_id("S", "l_suppkey").alias("doc_id"), text_id("P", "l_partkey").alias("chunk_id")).distinct()
    dead = supplier.filter("s_acctbal < 0").select(text_id("S", "s_suppkey").alias("doc_id"))
    after = delete_document(supplier.select(text_id("S", "s_suppkey").alias("doc_id")), held, part.select(text_id("P", "p_partkey").alias("chunk_id")), held, held, dead)
    return reduce(lambda a, b: a.unionByName(b), [after[k].agg(F.lit(k).alias("name"), F.count("*").alias("n")).select("name", "n") for k in ("documents", "has_chunk", "chunks", "mentions")])


@query(f"WITH {REGISTRY} SELECT chunk_id FROM registry WHERE doc_id = '3'")
def K14_delete_returning(spark, d):
    return provenance.remove_document(registry(spark, d), "3")[1]


@query("""WITH s AS (SELECT unnest(['PENDING','PARSING','EMBEDDING','EXTRACTING','RESOLVING','INDEXED','FAILED','DELETING']) AS s),
 ok AS (SELECT * FROM (VALUES ('PENDING','PARSING'),('PARSING','EMBEDDING'),('EMBEDDING','EXTRACTING'),('EXTRACTING','RESOLVING'),('RESOLVING','INDEXED'),('FAILED','PENDING')) v(a, b)
   UNION ALL SELECT s, 'FAILED' FROM s WHERE s NOT IN ('INDEXED','FAILED','DELETING') UNION ALL SELECT s, 'DELETING' FROM s WHERE s <> 'DELETING' UNION ALL SELECT s, s FROM s)
 SELECT x.s AS current, y.s AS status, CASE WHEN (x.s, y.s) IN (SELECT (a, b) FROM ok) THEN 'ok' ELSE 'illegal' END AS verdict FROM s x, s y
 UNION ALL SELECT NULL, s, 'unknown' FROM s""")
def K15_status_moves(spark, d):
    ledger = spark.createDataFrame([(s, s) for s in STATUSES], "doc_id string, status string")
    changes = spark.createDataFrame([(a, b) for a in (*STATUSES, "nobody") for b in STATUSES], "doc_id string, status string")
    return L.judged(ledger, changes).select("current", "status", "verdict")


@query("""SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND substr(sha256(text), 1, 1) >= '8'""")
def K17_purge_keeps_others(spark, d):
    ledger = old_ledger(spark, d)
    left, _ = L.purge(ledger, ledger.filter("substring(sha256, 1, 1) < '8'").select("doc_id"))
    return left.select("sha256")


@query("""SELECT 'old' || substr(sha256(text), 1, 12) AS doc_id, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS existed FROM documents GROUP BY 1""")
def K17_purge_tells_what_existed(spark, d):
    (docs,) = load(spark, d, "documents")
    asked = docs.select(F.concat(F.lit("old"), F.substring(F.sha2("text", 256), 1, 12)).alias("doc_id"))
    _, known = L.purge(old_ledger(spark, d), asked)
    return known.select("doc_id", "existed")


# -- filters --------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5)")
def F1_payload_filter(spark, d):
    (e,) = load(spark, d, "embeddings")
    rows = e.select("vec_id", "label", F.array("label").alias("labels"))
    return tables.payload_filter(rows, {"labels": [1, 3, 5, 77], "label": [1, 3, 5]}).select("vec_id", "label")


@query("SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND length(text) <= 2000")
def F5_F6_query_guard(spark, d):
    (c,) = load(spark, d, "conversations")
    return c.filter(scalars.valid_question(F.col("text"), Limits())).select("conv_id", "turn")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey
 WHERE l_linenumber >= 0 AND l_linenumber < l_linenumber + CAST(l_quantity AS INT) - 10 AND l_linenumber + CAST(l_quantity AS INT) - 10 <= length(p_name)""")
def F7_spans_inside_texts(spark, d):
    from ..plans.extract import valid_mentions

    lines, part = load(spark, d, "lineitem", "part")
    rows = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("char_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") - 10).alias("char_end"))
    found = valid_mentions(rows, part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text")))
    return found.select("l_orderkey", "l_linenumber", F.col("chunk_id").alias("l_partkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 50 >= 0.9 THEN 'merge' WHEN l_quantity / 50 <= 0.65 THEN 'reject' ELSE 'gray' END AS band FROM lineitem")
def F10_bands(spark, d):
    (lines,) = load(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", band(F.col("l_quantity") / 50, Resolution()).alias("band"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
 QUALIFY NOT bool_and(l_discount > 0) OVER (PARTITION BY l_orderkey) OR l_quantity >= 25""")
def F11_keep_whole_ungraded_batches(spark, d):
    from ..operators.evaluation import kept_by_grade

    (lines,) = load(spark, d, "lineitem")
    grade = F.when(F.col("l_discount") > 0, F.col("l_quantity") >= 25)  # none without a discount
    return kept_by_grade(lines, ["l_orderkey"], grade, F.col("l_quantity") >= 25).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT doc_id, CAST(CASE WHEN n_chars // 2 < 500 THEN 1 WHEN n_chars // 2 >= 502 AND n_chars // 2 < 2000 THEN 2 END AS INT) AS page FROM documents""")
def F12_page_of_place(spark, d):
    (docs,) = load(spark, d, "documents")
    pages = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 500), (502, 2000))])
    return docs.select("doc_id", page_of(F.floor(F.col("n_chars") / 2), pages).cast("int").alias("page"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber * 2 >= 12 OR l_quantity * 1000 >= 24000 OR l_extendedprice >= 45000 AS exhausted, CASE WHEN l_linenumber * 2 > 12 THEN 'llm_calls' WHEN l_extendedprice > 45000 THEN 'wall_ms' WHEN l_quantity * 1000 > 24000 THEN 'tokens' END AS breach FROM lineitem")
def F13_M3_budgets(spark, d):
    (lines,) = load(spark, d, "lineitem")
    spent = F.struct((F.col("l_linenumber") * 2).alias("llm_calls"), (F.col("l_quantity") * 1000).alias("tokens"), F.col("l_extendedprice").alias("wall_ms"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", scalars.exhausted(spent, Limits()).alias("exhausted"), scalars.breach(spent, Limits()).alias("breach"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 3 = 1 AS failed FROM orders")
def F14_failed_on_current_attempt(spark, d):
    (orders,) = load(spark, d, "orders")
    failure = F.struct(F.when(F.col("o_orderstatus") == "F", "judge").otherwise("other").alias("node"), (F.pmod("o_orderkey", F.lit(3))).cast("int").alias("attempt"))
    attempts = F.create_map(F.lit("judge"), F.lit(1))
    return orders.select("o_orderkey", scalars.failed_on_current_attempt(F.array(failure), attempts, "judge").alias("failed"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN '**********' ELSE CAST(value AS VARCHAR) END AS v, CASE WHEN user_id % 2 = 0 THEN '**********' ELSE 'plain' END AS w FROM events""")
def F15_redaction(spark, d):
    (events,) = load(spark, d, "events")
    key = F.when(F.col("event_type") == "click", "my_API-key").otherwise("note")
    secret = F.when(F.col("user_id") % 2 == 0, F.lit("sk-abc")).otherwise(F.lit("plain"))
    redacted = scalars.redact_map(F.create_map(key, F.col("value").cast("string"), F.lit("w"), secret), Trail())
    return events.select("event_id", F.element_at(redacted, key).alias("v"), F.element_at(redacted, F.lit("w")).alias("w"))


@query("SELECT doc_id, substr(text, 1, 1500) AS message, replace(substr(text, 1, 200), chr(10), ' ') AS snippet FROM documents")
def F16_X27_cut_fields(spark, d):
    from ..functions.text import snippet, truncated

    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", truncated(F.col("text"), Trail().truncate_chars).alias("message"), snippet(F.col("text")).alias("snippet"))


# -- joins ----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10")
def J1_resolve_surface(spark, d):
    from ..operators.resolution import attach_mentions

    lines, part = load(spark, d, "lineitem", "part")
    surfaces = part.filter("p_size > 10").select(F.col("p_partkey").alias("surface"), F.col("p_brand").alias("canonical_id"))
    return attach_mentions(lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("surface")), surfaces).select("l_orderkey", "l_linenumber", F.col("surface").alias("l_partkey"), F.col("entity_id").alias("p_brand"))


@query("""SELECT o_orderkey, c_name AS src_id, s_name AS dst_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON o_orderkey % 150 = s_suppkey""")
def J2_resolve_both_ends(spark, d):
    from ..operators.resolution import attach_relations

    orders, customer, supplier = load(spark, d, "orders", "customer", "supplier")
    rows = orders.select("o_orderkey", text_id("C", "o_custkey").alias("src_surface"), F.concat(F.lit("S"), (F.col("o_orderkey") % 150).cast("string")).alias("dst_surface"))
    surfaces = customer.select(text_id("C", "c_custkey").alias("surface"), F.col("c_name").alias("canonical_id")).unionByName(supplier.select(text_id("S", "s_suppkey").alias("surface"), F.col("s_name").alias("canonical_id")))
    return attach_relations(rows, surfaces).select("o_orderkey", "src_id", "dst_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def J3_known_chunks(spark, d):
    from ..plans.extract import valid_relations

    orders, lines = load(spark, d, "orders", "lineitem")
    return valid_relations(orders.select(F.col("o_orderkey").alias("chunk_id")), lines.select(F.col("l_orderkey").alias("chunk_id"))).select(F.col("chunk_id").alias("o_orderkey"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderkey")
def J4_J5_orphans(spark, d):
    orders, lines = load(spark, d, "orders", "lineitem")
    ids = orders.select(F.col("o_orderkey").alias("chunk_id"), "o_custkey")
    return provenance.orphans(ids, lines.select(F.col("l_orderkey").alias("chunk_id"))).select(F.col("chunk_id").alias("o_orderkey"), "o_custkey").orderBy("o_orderkey")


@query("""WITH h AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS chunk_id FROM lineitem)
 SELECT doc_id, chunk_id FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.chunk_id = h.chunk_id AND o.doc_id <> h.doc_id)""")
def J6_owned_by_one(spark, d):
    (lines,) = load(spark, d, "lineitem")
    held = lines.select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("chunk_id")).distinct()
    return provenance.only_owned(held, held)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def J7_cited_outside_context(spark, d):
    customer, orders = load(spark, d, "customer", "orders")
    return tables.delete_ids(customer.select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), []) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def J8_sources_or_empty(spark, d):
    customer, orders = load(spark, d, "customer", "orders")
    rows = orders.select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").alias("doc_id"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"), epoch().alias("ingested_at"))
    rows = rows.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    lists = provenance.source_lists(customer.select(F.col("c_custkey").alias("chunk_id")), rows)
    return lists.select(F.col("chunk_id").alias("c_custkey"), F.transform("sources", lambda s: s["doc_id"].cast("long")).alias("orders"))


@query("""SELECT conv_id, u AS doc_id, lang FROM (SELECT conv_id, unnest(list_concat(list(turn), list(turn))) AS u FROM conversations GROUP BY conv_id) JOIN documents ON doc_id = u""")
def J13_unnested_list(spark, d):
    conversations, docs = load(spark, d, "conversations", "documents")
    lists = conversations.groupBy("conv_id").agg(F.collect_list("turn").alias("l")).select("conv_id", F.concat("l", "l").alias("l"))
    return tables.unnest_join(lists, "l", docs.select("doc_id", "lang"), "doc_id").select("conv_id", "doc_id", "lang")


@query("""SELECT o_orderkey, list(p_brand ORDER BY l_linenumber, l_partkey) FILTER (WHERE p_partkey IS NOT NULL) AS brands
 FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey, p_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 30) ON l_orderkey = o_orderkey GROUP BY o_orderkey""".replace("SELECT o_orderkey, list(", "SELECT o_orderkey, coalesce(list(").replace("IS NOT NULL) AS brands", "IS NOT NULL), []) AS brands"))
def J17_hydrate_paths(spark, d):
    orders, lines, part = load(spark, d, "orders", "lineitem", "part")
    ids = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    paths = orders.select("o_orderkey").join(ids, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.transform("l", lambda x: x["l_partkey"]).alias("ids"))
    full = tables.hydrate(paths, ["o_orderkey"], "ids", part.filter("p_size < 30").withColumnRenamed("p_partkey", "chunk_id"), "chunk_id", ["p_brand"], "chunks")
    return full.select("o_orderkey", F.transform("chunks", lambda c: c["p_brand"]).alias("brands"))


@query("""SELECT n, event_id, source FROM (SELECT row_number() OVER (ORDER BY ts, source, 's' || event_id) AS n, event_id, source FROM (
 SELECT event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'log' ELSE 'span' END AS source FROM events)) WHERE n <= 500""")
def J20_P15_merged_trail(spark, d):
    (events,) = load(spark, d, "events")
    rows = events.select(F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type").isin("click", "view"), "log").otherwise("span").alias("source"), F.lit("INFO").alias("level"), F.col("event_type").alias("message"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("attributes"), F.lit(None).cast("string").alias("trace_id"), text_id("s", "event_id").alias("span_id"))
    both = trail.merged([rows.filter("source = 'log'"), rows.filter("source = 'span'")], Trail())
    return both.select(F.col("n").cast("long").alias("n"), F.element_at("attributes", "id").cast("long").alias("event_id"), "source")


@query("""SELECT user_id, n, event_id, n_all > 500 AS truncated FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS n_all FROM events) WHERE n <= 500""")
def T9_cap_with_flag(spark, d):
    (events,) = load(spark, d, "events")
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.lit("log").alias("source"), F.lit("INFO").alias("level"), F.col("event_type").alias("message"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("attributes"), F.lit(None).cast("string").alias("trace_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("span_id"))
    return trail.merged([rows], Trail(), ("user_id",)).select("user_id", F.col("n").cast("long").alias("n"), F.element_at("attributes", "id").cast("long").alias("event_id"), "truncated")


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) / 3) AS INTEGER) AS batch FROM conversations")
def W5_batches(spark, d):
    (c,) = load(spark, d, "conversations")
    return batched(c, ["conv_id"], ["turn", "role", "text"], 3).select("conv_id", "turn", "batch")


@query(f"SELECT doc_id, {uuid_sql(NORMAL.format('text'))} AS chunk_id FROM documents")
def X3_chunk_ids(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", chunk_id(F.col("text")).alias("chunk_id"))


@query("""WITH k AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
 SELECT sha256, 'INDEXED' AS status FROM k WHERE (instr('0123456789abcdef', substr(sha256, 1, 1)) - 1) % 8 = 5""")
def P13_forced_ingest_forgets_failures(spark, d):
    return L.purge_for_force(old_ledger(spark, d), uploads(spark, d)).select("sha256", "status")
