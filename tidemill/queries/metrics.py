"""Queries of aggregations, evaluation, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Backoff, Embedding, Evaluation, Resolution, Settings
from ..functions import scalars
from ..functions.identity import content_hash, document_id, entity_id
from ..functions.similarity import jaro_winkler
from ..functions.text import normalize_display, normalize_entity_name
from ..operators import evaluation as E
from ..operators import provenance, tables
from ..operators.chunking import chunk
from ..operators.components import components
from ..operators.resolution import choose_names, resolve
from ..plans.models import hash_embedder
from ..plans.orchestrate import REFUSAL
from .base import NORMAL, query, text_id, uuid_sql
from .base import tables as load

# -- resolution -----------------------------------------------------------------------------------------------------

SUFFIXES = ("", " Inc.", " GmbH")


def surfaces(spark, d):
    """Every customer mentions its nation under one of several names."""
    customer, nation = load(spark, d, "customer", "nation")
    named = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("c_custkey") % 3 + 1).cast("int"))
    word = F.substring(F.md5("n_name"), 1, 8)
    return named.select("c_custkey", F.concat(word, suffix).alias("surface"), word.alias("word"), F.when(F.col("n_regionkey") < 3, "ORG").otherwise("LOC").alias("type"))


@query("""SELECT o_custkey, o_orderpriority AS name FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, length(o_orderpriority) DESC, o_orderpriority) = 1""")
def A4_most_frequent_surface(spark, d):
    (orders,) = load(spark, d, "orders")
    return choose_names(orders.select("o_custkey", F.col("o_orderpriority").alias("surface")), ["o_custkey"])


@query(f"""WITH m AS (SELECT substr(md5(n_name), 1, 8) AS word, substr(md5(n_name), 1, 8) || (['', ' Inc.', ' GmbH'])[c_custkey % 3 + 1] AS surface, CASE WHEN n_regionkey < 3 THEN 'ORG' ELSE 'LOC' END AS type
   FROM customer JOIN nation ON c_nationkey = n_nationkey),
 c AS (SELECT word, type, surface, count(*) AS n FROM m GROUP BY ALL),
 best AS (SELECT word, type, surface AS name FROM c QUALIFY row_number() OVER (PARTITION BY word, type ORDER BY n DESC, length(surface) DESC, surface) = 1)
 SELECT {uuid_sql("lower(name) || chr(31) || type")} AS canonical_id, name, word AS name_normalized, type, list_sort(list(surface) FILTER (WHERE surface <> name)) AS aliases, CAST(sum(n) AS BIGINT) AS mention_count
 FROM c JOIN best USING (word, type) GROUP BY word, type, name""")
def P5_A3_A5_A6_resolution(spark, d):
    none = spark.createDataFrame([], "canonical_id string, name string, name_normalized string, type string, mention_count long")
    return resolve(surfaces(spark, d), none, hash_embedder(), Resolution()).entities


# Each nation's word with two misspellings as surfaces; every second nation is known under a misspelling, every third under its word.
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
KNOWN_RULES = Resolution(weight_jaro_winkler=0.5, weight_token_set=0.0, weight_cosine=0.5, merge_at=0.93, reject_at=0.8)
VECTOR = f"list_transform(string_split('{LETTERS}', ''), lambda c: CAST(length({{0}}) - length(replace({{0}}, c, '')) AS DOUBLE))"
_SCORE = f"0.5 * jaro_winkler_similarity(a.name, b.name) + 0.5 * list_cosine_similarity({VECTOR.format('a.name')}, {VECTOR.format('b.name')})"
_KNOWN_SQL = f"""WITH RECURSIVE w AS (SELECT n_nationkey, substr(md5(n_name), 1, 8) AS word, CASE WHEN n_regionkey < 3 THEN 'ORG' ELSE 'LOC' END AS type FROM nation),
 m AS (SELECT CASE c_custkey % 4 WHEN 0 THEN word || 'x' WHEN 1 THEN substr(word, 1, 5) || 'zzz' ELSE word END AS name, type FROM customer JOIN w ON c_nationkey = n_nationkey),
 g AS (SELECT {uuid_sql("name || chr(31) || type")} AS id, name, type, count(*) AS n FROM m GROUP BY name, type),
 k AS (SELECT {uuid_sql("name || chr(31) || type")} AS id, name, type, n FROM (SELECT word || 'x' AS name, type, 10 AS n FROM w WHERE n_nationkey % 2 = 0 UNION ALL SELECT word, type, 100 FROM w WHERE n_nationkey % 3 = 0)),
 near AS (
  SELECT a.id, b.id AS other, {_SCORE} AS score, false AS known FROM g a JOIN g b ON a.type = b.type AND (b.name, b.type) < (a.name, a.type)
  UNION ALL SELECT a.id, b.id, {_SCORE}, true FROM g a JOIN k b ON a.type = b.type
 ), pairs AS (SELECT id, other, max(score) AS score, bool_or(known) AS known FROM near GROUP BY id, other),
 links AS (SELECT id AS a, other AS b FROM pairs WHERE score >= 0.93 UNION SELECT other, id FROM pairs WHERE score >= 0.93),
 reach(a, b) AS (SELECT id, id FROM g UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
 cl AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)"""


def known_and_mentioned(spark, d):
    """(mentions, persisted entities, embedder): a name's vector counts its letters, so that SQL has it too."""
    nation, customer = load(spark, d, "nation", "customer")
    w = nation.select("n_nationkey", F.substring(F.md5("n_name"), 1, 8).alias("word"), F.when(F.col("n_regionkey") < 3, "ORG").otherwise("LOC").alias("type"))
    kind = F.col("c_custkey") % 4
    wrong = F.concat("word", F.lit("x"))
    surface = F.when(kind == 0, wrong).when(kind == 1, F.concat(F.substring("word", 1, 5), F.lit("zzz"))).otherwise(F.col("word"))
    mentions = customer.join(w, F.col("c_nationkey") == F.col("n_nationkey")).select(surface.alias("surface"), "type")
    known = w.filter("n_nationkey % 2 = 0").select(wrong.alias("name"), "type", F.lit(10).cast("long").alias("mention_count"))
    known = known.unionByName(w.filter("n_nationkey % 3 = 0").select(F.col("word").alias("name"), "type", F.lit(100).cast("long").alias("mention_count")))
    known = known.select(entity_id(F.col("name"), F.col("type")).alias("canonical_id"), "name", F.col("name").alias("name_normalized"), "type", "mention_count")
    return mentions, known, lambda c: F.array(*[(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double") for x in LETTERS])


@query(f"""{_KNOWN_SQL},
 facts AS (SELECT cluster, sum(n) AS n, list(DISTINCT name) AS names FROM g JOIN cl USING (id) GROUP BY cluster),
 best AS (SELECT cluster, name FROM g JOIN cl USING (id) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, length(name) DESC, name) = 1),
 held AS (SELECT cluster, min(id) AS id, sum(n) AS n, list(DISTINCT name) AS names FROM (SELECT DISTINCT cl.cluster, k.* FROM pairs p JOIN cl ON cl.id = p.id JOIN k ON k.id = p.other WHERE p.known AND p.score >= 0.93) GROUP BY cluster),
 kind AS (SELECT cluster, any_value(type) AS type FROM g JOIN cl USING (id) GROUP BY cluster)
 SELECT coalesce(held.id, {uuid_sql("name || chr(31) || type")}) AS canonical_id, name, type, list_sort(list_filter(list_distinct(list_concat(facts.names, coalesce(held.names, []))), lambda x: x <> name)) AS aliases, CAST(facts.n + coalesce(held.n, 0) AS BIGINT) AS mention_count
 FROM facts JOIN best USING (cluster) JOIN kind USING (cluster) LEFT JOIN held USING (cluster)""")
def P5_J14_resolution_with_known(spark, d):
    return resolve(*known_and_mentioned(spark, d), KNOWN_RULES).entities.select("canonical_id", "name", "type", "aliases", "mention_count")


@query(f"{_KNOWN_SQL} SELECT id AS a_id, other AS b_id, round(score, 9) AS score FROM pairs WHERE score > 0.8 AND score < 0.93")
def P5_F10_flagged_pairs(spark, d):
    return resolve(*known_and_mentioned(spark, d), KNOWN_RULES).flagged.select("a_id", "b_id", F.round("score", 9).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey <> n_regionkey UNION SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey <> n_regionkey),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a""")
def A7_components(spark, d):
    (nation,) = load(spark, d, "nation")
    return components(nation, "n_nationkey", "n_regionkey")


# Customers in chains of sixteen, some of which a hub holds together.
@query("""WITH RECURSIVE l AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 16 <> 15 UNION SELECT -1, c_custkey FROM customer WHERE c_custkey % 37 = 5),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a""")
def A7_chains_and_a_hub(spark, d):
    (customer,) = load(spark, d, "customer")
    key = F.col("c_custkey").cast("long")
    links = customer.filter("c_custkey % 16 <> 15").select(key.alias("a"), (key + 1).alias("b")).unionByName(customer.filter("c_custkey % 37 = 5").select(F.lit(-1).cast("long").alias("a"), key.alias("b")))
    return components(links)


@query("""SELECT a.n_name AS a, b.n_name AS b, round(jaro_winkler_similarity(a.n_name || ' ' || a.n_regionkey, b.n_name || ' ' || b.n_regionkey), 6) AS s FROM nation a, nation b""")
def X11_jaro_winkler(spark, d):
    (nation,) = load(spark, d, "nation")
    name = F.concat("n_name", F.lit(" "), F.col("n_regionkey").cast("string"))
    a = nation.select(F.col("n_name").alias("a"), name.alias("x"))
    b = nation.select(F.col("n_name").alias("b"), name.alias("y"))
    return a.crossJoin(b).select("a", "b", F.round(jaro_winkler(F.col("x"), F.col("y")), 6).alias("s"))


@query("""SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM customer""")
def X8_entity_names(spark, d):
    (customer,) = load(spark, d, "customer")
    rules = Resolution()
    dressed = F.concat(F.lit("Dr. "), "c_name", F.lit(" Private Limited, Inc."))
    return customer.select("c_custkey", normalize_entity_name(dressed, rules.suffixes, rules.honorifics).alias("name"))


# -- aggregations ---------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL""")
def A10_first_occurrence(spark, d):
    (lines,) = load(spark, d, "lineitem")
    return provenance.first_occurrences(lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("ord")).distinct()).select(F.col("doc_id").alias("l_orderkey"), F.col("chunk_id").alias("l_partkey"), F.col("ord").alias("l_linenumber"))


@query("""SELECT o_custkey, list(o_orderstatus ORDER BY f) AS statuses FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS f FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def A11_distinct_in_first_order(spark, d):
    (orders,) = load(spark, d, "orders")
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("doc_id")))).alias("sources"))
    return lists.select("o_custkey", provenance.doc_ids().alias("statuses"))


@query("SELECT l_orderkey, sum(l_linenumber) AS llm_calls, sum(CAST(l_quantity AS BIGINT)) AS tokens, max(l_extendedprice) AS wall_ms FROM lineitem GROUP BY l_orderkey")
def A13_spend(spark, d):
    (lines,) = load(spark, d, "lineitem")
    return lines.groupBy("l_orderkey").agg(*scalars.total_spent(F.col("l_linenumber"), F.col("l_quantity").cast("long"), F.col("l_extendedprice")))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 ELSE 1 END AS f, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 2 END AS other, o_orderkey % 5 + (CASE o_orderstatus WHEN 'F' THEN 3 ELSE 1 END) + CASE o_orderstatus WHEN 'F' THEN 0 ELSE 2 END AS total FROM orders""")
def A14_counter_maps(spark, d):
    (orders,) = load(spark, d, "orders")
    a = F.create_map(F.lit("F"), F.lit(1).cast("long"), F.lit("n"), F.col("o_orderkey") % 5)
    b = F.create_map(F.when(F.col("o_orderstatus") == "F", "F").otherwise("x"), F.lit(2).cast("long"))
    m = scalars.merge_counters(a, b)
    get = lambda k: F.coalesce(F.element_at(m, F.lit(k)), F.lit(0))
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x)
    return orders.select("o_orderkey", get("F").cast("int").alias("f"), get("x").cast("int").alias("other"), total.alias("total"))


@query("""SELECT user_id, list(event_type ORDER BY event_id) AS failures, list_sort(list_distinct(list(event_type))) AS degraded FROM events GROUP BY user_id""")
def A15_A16_appended_and_distinct(spark, d):
    (events,) = load(spark, d, "events")
    lists = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("l"))
    failures = F.transform("l", lambda x: x["event_type"])
    return lists.select("user_id", failures.alias("failures"), F.array_sort(F.array_distinct(failures)).alias("degraded"))


# -- evaluation -----------------------------------------------------------------------------------------------------


def golden(spark, d):
    """Orders are items; the parts of their first lines are gold, their status is the route."""
    orders, lines = load(spark, d, "orders", "lineitem")
    gold = lines.filter("l_linenumber <= 3").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(text_id("P", "l_partkey"))).alias("gold_chunk_ids"))
    return orders.join(gold, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("?").alias("question"), F.col("o_orderpriority").alias("category"), F.element_at(F.create_map(*[F.lit(x) for p in (("F", "vector"), ("O", "graph"), ("P", "hybrid")) for x in p]), F.col("o_orderstatus")).alias("gold_route"), "gold_chunk_ids", F.lit("a").alias("gold_answer"), (F.col("o_orderkey") % 10 == 0).alias("must_refuse"))


def outcomes(spark, d):
    orders, lines = load(spark, d, "orders", "lineitem")
    got = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct((-F.col("l_quantity")).alias("q"), text_id("P", "l_partkey").alias("p")))).alias("r"))
    route = F.element_at(F.array(F.lit("vector"), F.lit("graph"), F.lit("hybrid")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return orders.join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("item_id"), F.array_distinct(F.transform("r", lambda x: x["p"])).alias("retrieved"), route.alias("predicted_route"), (F.col("o_custkey") % 2 == 0).alias("refused"))


EVAL = """g AS (SELECT l_orderkey AS k, list(DISTINCT 'P' || l_partkey) AS gold FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
 r1 AS (SELECT k, p, min(pos) AS pos FROM (SELECT l_orderkey AS k, 'P' || l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, 'P' || l_partkey) AS pos FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem)) GROUP BY ALL),
 r AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY pos) AS rank FROM r1),
 h AS (SELECT r.k, r.rank FROM r JOIN g ON g.k = r.k AND list_contains(gold, p)),
 m AS (SELECT k, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hits, 1.0 / min(rank) AS rr, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY k),
 items AS (SELECT o_orderkey AS id, o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 'vector' WHEN 'O' THEN 'graph' ELSE 'hybrid' END AS gold_route, (['vector', 'graph', 'hybrid'])[o_custkey % 3 + 1] AS predicted_route,
   o_orderkey % 10 = 0 AS must_refuse, o_custkey % 2 = 0 AS refused, gold IS NOT NULL AS has_gold,
   CASE WHEN gold IS NULL THEN 0 ELSE CAST(coalesce(hits, 0) AS DOUBLE) / len(gold) END AS recall, CASE WHEN gold IS NULL THEN 0 ELSE CAST(coalesce(rr, 0) AS DOUBLE) END AS rr,
   CASE WHEN gold IS NULL THEN 0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(len(gold), 10) + 1), lambda x: 1 / log2(x + 1))) END AS ndcg
   FROM orders LEFT JOIN g ON g.k = o_orderkey LEFT JOIN m ON m.k = o_orderkey)"""


def items(spark, d):
    return E.item_metrics(golden(spark, d), outcomes(spark, d))


@query(f"WITH {EVAL} SELECT CAST(id AS VARCHAR) AS id, round(recall, 9) AS recall, round(rr, 9) AS rr, round(ndcg, 9) AS ndcg FROM items")
def A17_A18_A19_J18_item_metrics(spark, d):
    return items(spark, d).select("id", *[F.round(c, 9).alias(c) for c in ("recall", "rr", "ndcg")])


@query(f"""WITH {EVAL} SELECT round(coalesce(avg(recall) FILTER (WHERE has_gold), 0), 9) AS recall_at_10, round(coalesce(avg(rr) FILTER (WHERE has_gold), 0), 9) AS mrr, round(coalesce(avg(ndcg) FILTER (WHERE has_gold), 0), 9) AS ndcg_at_10,
 round(avg(CASE WHEN predicted_route = gold_route THEN 1.0 ELSE 0 END), 9) AS routing_accuracy, round(avg(CASE WHEN refused THEN 1.0 ELSE 0 END) FILTER (WHERE must_refuse), 9) AS refusal_rate_on_unanswerable FROM items""")
def A20_A21_A23_summary(spark, d):
    s = E.summary(items(spark, d))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query(f"""WITH {EVAL}, l AS (SELECT unnest(['vector', 'graph', 'hybrid']) AS l) SELECT a.l AS predicted, b.l AS gold, (SELECT count(*) FROM items WHERE predicted_route = a.l AND gold_route = b.l) AS n FROM l a, l b""")
def A22_U5_confusion(spark, d):
    return E.confusion(items(spark, d))


@query(f"""WITH {EVAL} SELECT category, round(coalesce(avg(recall) FILTER (WHERE has_gold), 0), 9) AS recall_at_10, round(coalesce(avg(rr) FILTER (WHERE has_gold), 0), 9) AS mrr, count(*) AS count FROM items GROUP BY category""")
def A24_by_category(spark, d):
    return E.by_category(items(spark, d)).select("category", F.round("recall_at_10", 9).alias("recall_at_10"), F.round("mrr", 9).alias("mrr"), "count")


@query(f"""WITH {EVAL}, s AS (SELECT coalesce(avg(recall) FILTER (WHERE has_gold), 0) AS recall, avg(CASE WHEN predicted_route = gold_route THEN 1.0 ELSE 0 END) AS routing, avg(CASE WHEN refused THEN 1.0 ELSE 0 END) FILTER (WHERE must_refuse) AS refusal FROM items)
 SELECT metric, round(score, 9) AS score, threshold, score >= threshold AS passed FROM (SELECT 'recall_at_10' AS metric, recall AS score, CAST(0.70 AS DOUBLE) AS threshold FROM s UNION ALL SELECT 'faithfulness', 0, 0.80 UNION ALL SELECT 'answer_relevancy', 0, 0.75
  UNION ALL SELECT 'routing_accuracy', routing, 0.75 FROM s UNION ALL SELECT 'refusal_rate_on_unanswerable', refusal, 0.80 FROM s)""")
def A25_gate(spark, d):
    return E.gate(E.summary(items(spark, d)), Evaluation().thresholds).withColumn("score", F.round("score", 9))


@query("""SELECT round(avg(CASE WHEN l_discount > 0 THEN l_tax / l_discount END), 9) AS faithfulness, round(avg(l_tax), 9) AS relevancy FROM lineitem""")
def A26_means_without_nan(spark, d):
    (lines,) = load(spark, d, "lineitem")
    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.nullif("l_discount", F.lit(0.0))).otherwise(F.lit(float("nan")))
    means = E.judge_means(lines.select(ratio.alias("faithfulness"), F.col("l_tax").alias("relevancy")), ["faithfulness", "relevancy"])
    return means.select(*[F.round(c, 9).alias(c) for c in means.columns])


# -- scalar functions -----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({NORMAL.format('text')}) AS content_hash FROM documents")
def X1_X2_content_hash(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT c_custkey, {uuid_sql('lower(c_name) || chr(31) || c_mktsegment')} AS entity_id FROM customer")
def X4_entity_ids(spark, d):
    (customer,) = load(spark, d, "customer")
    return customer.select("c_custkey", entity_id(F.col("c_name"), F.col("c_mktsegment")).alias("entity_id"))


@query(f"SELECT doc_id, {uuid_sql('text')} AS document_id FROM documents")
def X5_document_ids(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", document_id(F.col("text").cast("binary")).alias("document_id"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g') AS text FROM documents")
def X7_display_form(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", normalize_display(F.col("text")).alias("text"))


_CUT = Settings().chunking
# Units end after paragraphs and sentences; a longer one falls into words, and a word into pieces.  Chunks take units while they fit, and
# a short one joins the one before.
@query(rf"""WITH RECURSIVE u AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?s).*?(?:(?:[.!?]\s*)?\n\s*\n|[.!?]\s+|\z)') AS units FROM documents WHERE length(text) > {_CUT.chunk_size}
), w AS (
  SELECT doc_id, text, flatten(list_transform(units, lambda x: CASE WHEN length(x) > {_CUT.chunk_size} THEN regexp_extract_all(x, '(?s).*?(?:\s+|\z)') ELSE [x] END)) AS words FROM u
), l AS (
  SELECT doc_id, text, list_filter(flatten(list_transform(words, lambda x: list_transform(range(0, length(x), {_CUT.chunk_size}), lambda s: least({_CUT.chunk_size}, length(x) - s)))), lambda n: n > 0) AS sizes FROM w
), c AS (SELECT doc_id, text, list_prepend(0, list_transform(range(1, len(sizes) + 1), lambda i: CAST(list_sum(sizes[1:i]) AS BIGINT))) AS cuts FROM l),
p AS (
  SELECT doc_id, 0 AS nth, CAST(1 AS BIGINT) AS i, CAST(len(list_filter(cuts, lambda x: x <= {_CUT.chunk_size})) AS BIGINT) AS j, cuts FROM c
  UNION ALL
  SELECT doc_id, nth + 1, n, CAST(len(list_filter(cuts, lambda x: x <= cuts[n] + {_CUT.chunk_size})) AS BIGINT), cuts
  FROM (SELECT *, CASE WHEN back > i THEN back ELSE i + 1 END AS n FROM (SELECT *, least(CAST(len(list_filter(cuts, lambda x: x <= cuts[j] - {_CUT.chunk_overlap})) AS BIGINT), j - 1) AS back FROM p WHERE j < len(cuts)))
), packed AS (SELECT doc_id, list([{{'a': cuts[i], 'b': cuts[j]}}] ORDER BY nth) AS parts FROM p GROUP BY doc_id),
joined AS (
  SELECT doc_id, list_reduce(parts, lambda o, x: CASE WHEN x[1].b - x[1].a < {_CUT.min_chunk_chars} AND x[1].b - o[-1].a <= {_CUT.chunk_size} THEN list_append(o[:-2], {{'a': o[-1].a, 'b': x[1].b}}) ELSE list_append(o, x[1]) END) AS chunks FROM packed
), found AS (
  SELECT doc_id, unnest(range(len(chunks))) AS ord, unnest(chunks) AS c FROM joined
  UNION ALL SELECT doc_id, 0, {{'a': 0, 'b': length(text)}} FROM documents WHERE length(text) BETWEEN 1 AND {_CUT.chunk_size}
)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(c.a AS INTEGER) AS char_start, CAST(c.b AS INTEGER) AS char_end, sha256(substr(text, CAST(c.a AS BIGINT) + 1, CAST(c.b - c.a AS BIGINT))) AS digest FROM found JOIN documents USING (doc_id)""")
def X9_W6_chunks(spark, d):
    (docs,) = load(spark, d, "documents")
    return chunk(docs.select("doc_id", "text"), Settings().chunking).select("doc_id", "ord", "char_start", "char_end", F.sha2("text", 256).alias("digest"))


@query("""SELECT item_id, 'ret:' || sha256(text || chr(31) || '20' || chr(31) || 'cfg' || chr(31) || '3') AS retrieval, 'emb:m:' || sha256(text) AS embedding, 'Represent this sentence for searching relevant passages: ' || text AS query FROM benchmark""")
def X14_X15_X17_cache_keys(spark, d):
    (bench,) = load(spark, d, "benchmark")
    t = F.col("text")
    return bench.select("item_id", scalars.retrieval_cache_key(t, F.lit(20), "cfg", F.lit(3)).alias("retrieval"), scalars.embedding_cache_key(t, "m").alias("embedding"), scalars.query_text(t, Embedding()).alias("query"))


@query(f"""SELECT conv_id, turn, turn * 0.1 < 0.3 OR regexp_matches(lower(text), 'cannot|don''t have|no information|not available|unable to') AS refused, {'false' if not any(p in REFUSAL.lower() for p in scalars.REFUSALS) else 'true'} AS standard FROM conversations""")
def X20_refusals(spark, d):
    (c,) = load(spark, d, "conversations")
    return c.select("conv_id", "turn", scalars.is_refusal(F.col("turn") * 0.1, F.col("text")).alias("refused"), scalars.is_refusal(F.lit(1.0), F.lit(REFUSAL)).alias("standard"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def X21_X22_json(spark, d):
    (events,) = load(spark, d, "events")
    return events.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT event_id, date_trunc('microsecond', ts) AS at, CASE WHEN event_id % 3 = 2 THEN 'ERROR' ELSE 'INFO' END AS level FROM events")
def X23_X25_times_and_levels(spark, d):
    (events,) = load(spark, d, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)") * 1000 + 7
    return events.select("event_id", scalars.epoch_ns(ns).cast("timestamp_ntz").alias("at"), scalars.status_level(F.col("event_id") % 3).alias("level"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN least(o_orderkey, 120) ELSE least(2 * pow(2, greatest(o_orderkey % 12 - 1, 0)), 120) END AS wait FROM orders")
def X24_backoff(spark, d):
    (orders,) = load(spark, d, "orders")
    return orders.select("o_orderkey", scalars.backoff_s(F.col("o_orderkey") % 12, F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey")), Backoff()).alias("wait"))


@query("SELECT item_id, '# judge v1' || chr(10) || 'Score from 0 to 1 how well the chunks support the answer.' || chr(10) || chr(10) || '## answer' || chr(10) || text || chr(10) || chr(10) || '## chunks' || chr(10) || '[' || item_id || ']' || chr(10) || text AS prompt FROM benchmark")
def X26_prompts(spark, d):
    from ..plans.prompts import chunk_lines, render

    (bench,) = load(spark, d, "benchmark")
    chunks = F.array(F.struct(F.col("item_id").cast("string").alias("chunk_id"), "text"))
    return bench.select("item_id", render("judge", answer=F.col("text"), chunks=chunk_lines(chunks)).alias("prompt"))


# -- sets, caches, checks -------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, list_sort(list_filter(list_distinct(list(o_orderpriority)), lambda x: x <> '5-LOW')) AS rest, list_sort(list_intersect(list_distinct(list(o_orderpriority)), ['1-URGENT', '2-HIGH'])) AS both FROM orders GROUP BY o_custkey""")
def U3_U4_sets(spark, d):
    (orders,) = load(spark, d, "orders")
    names = orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    return names.select("o_custkey", F.array_sort(F.array_except("s", F.array(F.lit("5-LOW")))).alias("rest"), F.array_sort(F.array_intersect("s", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).alias("both"))


@query("""SELECT k, leg FROM (SELECT o_custkey AS k, 0 AS leg FROM orders UNION ALL SELECT c_custkey, 1 FROM customer) QUALIFY row_number() OVER (PARTITION BY k ORDER BY leg) = 1""")
def U2_J14_union_by_priority(spark, d):
    orders, customer = load(spark, d, "orders", "customer")
    both = orders.select(F.col("o_custkey").alias("k"), F.lit(0).alias("leg")).unionByName(customer.select(F.col("c_custkey").alias("k"), F.lit(1).alias("leg")))
    return tables.first_by(both, ["k"], ["leg"])


@query("SELECT doc_id, length(text) AS n FROM documents")
def M6_read_through_cache(spark, d):
    docs, labels = load(spark, d, "documents", "labels")
    texts = docs.select("doc_id", "text").withColumn("key", F.sha2("text", 256))
    cache = texts.join(labels, "doc_id", "left_semi").select("key", F.length("text").cast("long").alias("n")).dropDuplicates(["key"])
    answers, _ = tables.read_through(texts, cache, "key", lambda rows: rows.withColumn("n", F.length("text").cast("long")))
    return answers.select("doc_id", "n")


@query("SELECT vec_id, len(embedding) AS n FROM embeddings")
def M1_M2_checked_vectors(spark, d):
    from ..schemas import check_sparse, check_width

    (e,) = load(spark, d, "embeddings")
    rows = check_width(e, "embedding", 64).select("vec_id", "embedding", F.sequence(F.lit(0), F.size("embedding") - 1).alias("i"))
    return check_sparse(rows, "i", "embedding").select("vec_id", F.size("embedding").cast("long").alias("n"))
