"""Queries over tables that are kept: mutations in place, and the life of documents on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.numbering import positions
from ..shared import materialize, new_path
from ..sources.keyed import KeyedTable
from ..streaming.lifecycle import MOVES, RATE_LIMITED, VERDICTS, Lifecycle, run_moves
from .base import RELATES, query, relates, text_id
from .base import tables as load


@query("""SELECT 'C' || c_custkey AS canonical_id, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name, c_mktsegment AS type, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS balance, 'old' AS created_at
       FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 5 <> 0
       UNION ALL SELECT 'C' || s_suppkey, s_name, NULL, s_acctbal, 'new' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)""")
def K3_K7_merge_in_place(spark, d):
    """Customers are the table, of which every fifth is deleted; suppliers are merged into it and keep what they lack."""
    customer, supplier = load(spark, d, "customer", "supplier")
    table = KeyedTable(spark, new_path(spark, "entities"), "canonical_id string, name string, type string, balance double, created_at string", ["canonical_id"])
    key = text_id("C", "c_custkey").alias("canonical_id")
    table.replace(customer.select(key, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("balance"), F.lit("old").alias("created_at")), ["name"])
    table.delete(customer.filter("c_custkey % 5 = 0").select(key))
    table.merge(supplier.select(text_id("C", "s_suppkey").alias("canonical_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), ["name"], {"created_at": F.lit("new")})
    return table.read()


@query(f"WITH {RELATES} SELECT type, count(*) AS n, round(sum(confidence), 4) AS total FROM relates GROUP BY type")
def K10_merge_in_place(spark, d):
    rows = materialize(relates(spark, d), "relations")  # read by both changes, each time for its buckets and for its rows
    schema = "src_id string, dst_id string, type string, confidence double, chunk_id string, doc_id string, evidence_span string"
    table = KeyedTable(spark, new_path(spark, "relates"), schema, ["src_id", "dst_id", "type", "chunk_id", "doc_id"])
    table.insert(rows.filter("type = 'SUPPLIES_A'").withColumn("confidence", F.lit(0.0)), ["confidence"])
    table.merge(rows, ["confidence"])
    return table.read().groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS nth_of_flag FROM lineitem")
def W1_T8_numbered_lines(spark, d):
    """Every line of the table and of each of three flags under its number, with no task that holds a flag."""
    (lines,) = load(spark, d, "lineitem")
    rows = lines.select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_extendedprice", "l_partkey", "l_suppkey")
    own = positions(rows, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag"], "nth_of_flag")
    both = positions(own, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], name="nth")
    return both.select("l_orderkey", "l_linenumber", (F.col("nth") + 1).alias("nth"), (F.col("nth_of_flag") + 1).alias("nth_of_flag"))


_HOURS = 12
_STATES = "['PENDING', 'PARSING', 'EMBEDDING', 'EXTRACTING', 'RESOLVING', 'INDEXED']"
_WORK = "('PARSING', 'EMBEDDING', 'EXTRACTING', 'RESOLVING')"


# Each user is a document whose events ask for one state after the other; errors fail it, half of them by a rate limit.
@query(f"""WITH RECURSIVE m AS (
  SELECT CAST(user_id AS VARCHAR) AS doc_id, ts AS at_ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth,
    CASE WHEN event_type = 'error' THEN 'FAILED' ELSE ({_STATES})[CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 6 + 1 AS BIGINT)] END AS wanted,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'RATE_LIMITED' ELSE 'PARSE_ERROR' END END AS error
  FROM events
), s AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS VARCHAR) AS status, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS since, CAST(NULL AS TIMESTAMP) AS over_at, CAST(NULL AS VARCHAR) AS over_from, 0 AS over_attempts,
    CAST(NULL AS TIMESTAMP) AS at_ts, CAST(NULL AS VARCHAR) AS current, CAST(NULL AS VARCHAR) AS got, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS VARCHAR) AS error
  FROM (SELECT DISTINCT doc_id FROM m)
  UNION ALL
  SELECT doc_id, nth, CASE WHEN verdict IN ('ok', 'retry') THEN got ELSE s1 END, after, CASE WHEN verdict IN ('ok', 'retry') THEN at_ts ELSE since1 END, over_at, CASE WHEN over_at IS NOT NULL THEN status END, attempts, at_ts, s1, got, verdict, error
  FROM (
    SELECT *, CASE WHEN limited AND after < 3 THEN 'PENDING' ELSE wanted END AS got,
      CASE WHEN s1 IS NULL THEN CASE WHEN wanted = 'PENDING' THEN 'ok' ELSE 'unknown' END
           WHEN limited THEN CASE WHEN after < 3 THEN 'retry' ELSE 'ok' END
           WHEN wanted = s1 OR (wanted = 'FAILED' AND (s1 = 'PENDING' OR s1 IN {_WORK})) OR (s1 = 'FAILED' AND wanted = 'PENDING')
             OR (list_position({_STATES}, wanted) = list_position({_STATES}, s1) + 1) THEN 'ok'
           ELSE 'illegal' END AS verdict
    FROM (
      SELECT *, attempts + CASE WHEN limited THEN 1 ELSE 0 END AS after FROM (
        SELECT *, wanted = 'FAILED' AND coalesce(error, '') = 'RATE_LIMITED' AND coalesce(s1 = 'PENDING' OR s1 IN {_WORK}, false) AS limited FROM (
          SELECT *, CASE WHEN over_at IS NOT NULL THEN 'FAILED' ELSE status END AS s1, coalesce(over_at, since) AS since1 FROM (
            SELECT s.doc_id, m.nth, s.status, s.attempts, s.since, m.at_ts, m.wanted, m.error,
              CASE WHEN s.status IN {_WORK} AND m.at_ts > s.since + INTERVAL {_HOURS} HOUR THEN s.since + INTERVAL {_HOURS} HOUR END AS over_at
            FROM s JOIN m ON m.doc_id = s.doc_id AND m.nth = s.nth + 1)))))
), rows AS (
  SELECT doc_id, at_ts, current, got AS status, verdict, error AS error_code, attempts FROM s WHERE nth > 0
  UNION ALL SELECT doc_id, over_at, over_from, 'FAILED', 'expired', 'JOB_TIMEOUT', over_attempts FROM s WHERE over_at IS NOT NULL
  UNION ALL SELECT doc_id, since + INTERVAL {_HOURS} HOUR, status, 'FAILED', 'expired', 'JOB_TIMEOUT', attempts FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY nth DESC) = 1) WHERE status IN {_WORK}
)
SELECT doc_id, epoch_us(at_ts) AS at_us, current, status, verdict, error_code, attempts FROM rows""")
def K15_M7_stream_lifecycle(spark, d):
    (events,) = load(spark, d, "events")
    nth = positions(events, ["event_id"], ["user_id"], "nth")
    states = F.array(*[F.lit(s) for s in ("PENDING", "PARSING", "EMBEDDING", "EXTRACTING", "RESOLVING", "INDEXED")])
    failed = F.col("event_type") == "error"
    moves = nth.select(
        F.col("user_id").cast("string").alias("doc_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(failed, "FAILED").otherwise(F.get(states, (F.col("nth") % 6).cast("int"))).alias("status"),
        F.when(failed, F.when(F.col("event_id") % 2 == 0, RATE_LIMITED).otherwise("PARSE_ERROR")).alias("error_code"),
    )
    moves = materialize(moves, "moves")  # read by each quarter
    arrivals, out, checkpoint = (new_path(spark, n) for n in ("arrivals", "verdicts", "checkpoint"))
    span = moves.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    cuts = [span["first"] + (span["last"] - span["first"]) * n / 4 for n in range(4)]
    for n, cut in enumerate(cuts):  # arrivals in the order of time
        part = moves.filter((F.col("at") >= F.lit(cut)) & (F.col("at") < F.lit(cuts[n + 1]) if n < 3 else F.lit(True)))
        part.repartition("doc_id").write.mode("append").parquet(arrivals)  # a document's moves of a quarter are in one file
    for days in (1000, 2000):  # what stands still at the end has had its time
        spark.range(1).select(F.lit("-").alias("doc_id"), F.lit(0).cast("long").alias("seq"), (F.lit(span["last"]) + F.make_dt_interval(F.lit(days))).alias("at"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("error_code")).write.mode("append").parquet(arrivals)
    files = max(8, -(-len(spark.read.schema(MOVES).parquet(arrivals).inputFiles()) // 8))  # about eight batches, however many files there are
    run_moves(spark, arrivals, out, checkpoint, Lifecycle(timeout_s=_HOURS * 3600), late=f"{int((span['last'] - span['first']).total_seconds() / 4) + 1} seconds", files=files).awaitTermination()
    found = spark.read.schema(VERDICTS).parquet(out).filter("doc_id <> '-'")
    return found.select("doc_id", F.unix_micros("at").alias("at_us"), "current", "status", "verdict", "error_code", "attempts")
