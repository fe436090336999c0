"""The operators of this subpackage bound to the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .html_text import extract_text
from .language import identify_language
from .licenses import scan_licenses
from .merkle import manifest
from .mixing import mix
from .neardup import near_duplicates
from .neighbours import nearest
from .packing import pack
from .quality import score_quality
from .spelling import variants, vocabulary
from .storage import read_table
from .token_counts import count_tokens
from .toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), each_row=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, docs, read_table(spark, sf_dir, "labels"))
    places = F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_sentences"), F.array_join(places, ",").alias("sentences"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"),
        F.get("matches", F.lit(0))["start"].alias("first_start"),
    )


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every seventh id by its digest is presented with another length
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(read_table(spark, sf_dir, "documents"), {"n_chars": tampered})


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(read_table(spark, sf_dir, "documents"), typing=97))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_near_duplicates, op3_language, op4_html_text, op5_token_counts, op6_quality, op7_toxicity, op8_licenses, op9_packing, op10_neighbours, op11_merkle, op12_mixing, op13_spelling)}


_OP1 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM iw WHERE len(w) > 0)
), widths AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, widths WHERE len(w) >= n)
), hit AS (
  SELECT spot.doc_id, spot.s, spot.n, win.item_id FROM spot JOIN win USING (n, k)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP2 = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS s FROM dw WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q ON p.k = q.k AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN size s ON s.doc_id = x.a JOIN size t ON t.doc_id = x.b WHERE 100 * x.c >= 75 * (s.n + t.n - x.c)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least_reached AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM dw d LEFT JOIN size s USING (doc_id) LEFT JOIN least_reached r ON r.a = d.doc_id
"""


_OP10 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""


# The notices that the tables hold; the operator also finds altered and longer ones (see its tests).
_OP8 = r"""
WITH n AS (
  SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '\blicensed under the apache license, version 2[.]0\b|\breleased under the mit license\b|\bthis work is licensed under the gnu general public license, version 3\b|\blicensed under cc by-nc 4[.]0\b') AS m
  FROM documents
)
SELECT doc_id, CAST(len(m) AS INTEGER) AS n_notices,
       array_to_string(list_sort(list_distinct(list_transform(m, lambda x: CASE WHEN x LIKE '%apache%' THEN 'Apache-2.0' WHEN x LIKE '%mit%' THEN 'MIT' WHEN x LIKE '%gnu%' THEN 'GPL-3.0' ELSE 'CC-BY-NC-4.0' END))), ',') AS licenses,
       CASE WHEN len(m) > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS coverage,
       CASE WHEN len(m) > 0 THEN CAST(instr(low, m[1]) - 1 AS INTEGER) END AS first_start
FROM n
"""


def _crc32(code_points: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    bits = f"flatten([[4294967295], flatten(list_transform({code_points}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))])"
    step = "lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    return f"xor(list_reduce(CAST({bits} AS BIGINT[]), {step}), 4294967295)"


_DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: unicode(c))"
_LEAF = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))
_OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_LEAF.format(n="n_chars")}) AS leaf, sha256({_LEAF.format(n=f"(n_chars + CASE WHEN {_crc32(_DIGITS)} % 7 = 0 THEN 1 ELSE 0 END)")}) AS shown FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (
  SELECT lang, 0 AS lvl, place, leaf AS node, n FROM placed
  UNION ALL SELECT lang, lvl + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, lvl, place // 2
), subroots AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, place, node, n FROM subroots
  UNION ALL SELECT lvl + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 1) // 2) FROM upper WHERE n > 1 GROUP BY lvl, place // 2
), climbed AS (
  SELECT doc_id, lang, leaf, 0 AS lvl, place, n, shown AS folded, '' AS proof FROM placed
  UNION ALL SELECT c.doc_id, c.lang, c.leaf, c.lvl + 1, c.place // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.place % 2 = 1 THEN s.node || c.folded ELSE c.folded || coalesce(s.node, '') END), c.proof || coalesce(s.node, '')
  FROM climbed c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.lvl = c.lvl AND s.place = xor(c.place, 1) WHERE c.n > 1
), topped AS (
  SELECT c.doc_id, c.leaf, r.node AS subroot, 0 AS lvl, r.place, r.n, c.folded, c.proof FROM climbed c JOIN subroots r ON r.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.place // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.place % 2 = 1 THEN s.node || c.folded ELSE c.folded || coalesce(s.node, '') END), c.proof || coalesce(s.node, '')
  FROM topped c LEFT JOIN upper s ON s.lvl = c.lvl AND s.place = xor(c.place, 1) WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, u.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.node AS verified
FROM topped JOIN (SELECT node FROM upper WHERE n = 1) u ON topped.n = 1
"""


def _op12(fills: int = 2) -> str:
    """Targets by the order in which sources stop, then the passes of the draw, each a running total by rank."""
    passes = "".join(
        f"""
, c{k} AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY bin + 4096 * times, rank, doc_id) <= open AS fits FROM r{k} WHERE size <= open AND size > 0 AND whole + times < 3
), t{k} AS (SELECT doc_id, source, size FROM c{k} WHERE fits),
r{k + 1} AS (
  SELECT r.* REPLACE (r.open - coalesce(g.got, 0) AS open, r.times + CASE WHEN r.doc_id IN (SELECT doc_id FROM t{k}) THEN 1 ELSE 0 END AS times)
  FROM r{k} r LEFT JOIN (SELECT source, sum(size) AS got FROM t{k} GROUP BY source) g ON g.source IS NOT DISTINCT FROM r.source
)"""
        for k in range(fills + 1)
    )
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM s),
f AS (
  SELECT *, row_number() OVER o AS nth, (SELECT sum(source_size) FROM s) - (sum(cap) OVER o - cap) AS words, sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST) AS rest
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), stop AS (SELECT min(nth) AS nth FROM f WHERE weight * words <= cap * rest),
share AS (SELECT words, rest FROM f JOIN stop USING (nth)),
t AS (
  SELECT source, source_size, CASE WHEN f.nth < stop.nth THEN cap ELSE weight * share.words END::BIGINT AS num, CASE WHEN f.nth < stop.nth THEN 1 ELSE share.rest END::BIGINT AS den FROM f, stop, share
), p AS (SELECT *, CASE WHEN source_size > 0 THEN num // (den * source_size) ELSE 0 END AS whole FROM t),
q AS (SELECT *, num // den - whole * source_size AS open FROM p),
ranked AS (
  SELECT d.doc_id, d.source, d.size, q.open, q.whole, 0 AS times, (u / (1 - u)) / ((q.open::DOUBLE / q.source_size) / (1 - q.open::DOUBLE / q.source_size)) AS rank
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE q.open > 0
), r0 AS (SELECT *, floor(rank / (1 + rank) * 4096) AS bin FROM ranked){passes}
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, q.source_size, q.num::DOUBLE / q.den AS target,
       CAST((q.whole + coalesce(times, 0)) * d.size AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN r{fills + 1} r ON r.doc_id = d.doc_id
"""


_BYTES = "flatten(list_transform(string_split({s}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
_OP13 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), h AS (SELECT run, c, {_crc32(_BYTES.format(s="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM runs),
v AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, cut.word, cut.n FROM v JOIN cut ON v.word = cut.rest
  UNION SELECT cut.word, v.word, v.n FROM v JOIN cut ON v.word = cut.rest
), best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND near.n = best.most) END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n
  FROM v LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS root FROM f UNION ALL SELECT followed.word, f.form FROM followed JOIN f ON f.word = followed.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, f.form_n, followed.root
FROM f JOIN followed USING (word) JOIN f r ON r.word = followed.root AND r.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1, "op2_near_duplicates": _OP2, "op8_licenses": _OP8, "op10_neighbours": _OP10, "op11_merkle": _OP11, "op12_mixing": _op12(), "op13_spelling": _OP13}
