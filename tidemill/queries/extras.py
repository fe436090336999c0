"""Queries beyond the retrieval engine's own operators, in the same lake: rollups, set operations, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches, temporal
from ..shared import materialize, new_path
from ..streaming.joins import follows, run_table
from ..streaming.jobs import event_windows, sessions
from .base import query
from .base import tables as load


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def extra_pricing_summary(spark, d):
    (lines,) = load(spark, d, "lineitem")
    rows = lines.filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, o_orderstatus)""")
def extra_cube(spark, d):
    orders, customer, nation = load(spark, d, "orders", "customer", "nation")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return rows.cube("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def extra_intersect(spark, d):
    customer, supplier = load(spark, d, "customer", "supplier")
    return customer.select(F.col("c_nationkey").alias("k")).intersect(supplier.select("s_nationkey"))


@query("SELECT l_partkey AS k FROM lineitem EXCEPT ALL SELECT p_partkey FROM part")
def extra_except_all(spark, d):
    lines, part = load(spark, d, "lineitem", "part")
    return lines.select(F.col("l_partkey").alias("k")).exceptAll(part.select("p_partkey"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def extra_event_windows(spark, d):
    (events,) = load(spark, d, "events")
    return event_windows(events).select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s""")
def extra_sessions(spark, d):
    (events,) = load(spark, d, "events")
    return sessions(events).select("user_id", "start", "n")


@query("""SELECT n_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(n_name, o_orderstatus) AS BIGINT) AS level FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)""")
def extra_A29_rollup(spark, d):
    orders, customer, nation = load(spark, d, "orders", "customer", "nation")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return rows.rollup("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), (l_returnflag, l_linenumber))""")
def extra_A29_grouping_sets(spark, d):
    (lines,) = load(spark, d, "lineitem")
    a, b, c = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    return lines.groupingSets([[a, b], [c], [a, c]], a, b, c).agg(F.count("*").alias("n"))


# Sketches of each day are kept as columns and merged; every estimate has to lie within the sketch's error of the exact rank or count.
@query("""SELECT event_type, q, true AS within FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS q)""")
def extra_A28_merged_quantiles(spark, d):
    (events,) = load(spark, d, "events")
    daily = sketches.daily(events, "ts", "event_type", "value", "user_id")
    estimates = sketches.quantiles(sketches.merged(daily, ["event_type"]), [0.1, 0.5, 0.9, 0.99])
    ranked = events.join(estimates, "event_type").groupBy("event_type", "q").agg(F.avg((F.col("value") <= F.col("estimate")).cast("double")).alias("rank"))
    return ranked.select("event_type", "q", (F.abs(F.col("rank") - F.col("q")) <= sketches.RANK_ERROR).alias("within"))


@query("""SELECT event_type, true AS within FROM events GROUP BY event_type""")
def extra_A28_merged_distinct(spark, d):
    (events,) = load(spark, d, "events")
    daily = sketches.daily(events, "ts", "event_type", "value", "user_id")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    found = sketches.merged(daily, ["event_type"]).select("event_type", sketches.distinct_of("who").alias("estimate")).join(exact, "event_type")
    return found.select("event_type", (F.abs(F.col("estimate") - F.col("n")) <= sketches.COUNT_ERROR * F.col("n")).alias("within"))


@query("""SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def extra_J21_last_view_before_purchase(spark, d):
    (events,) = load(spark, d, "events")
    seen = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("viewed"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return temporal.last_before(bought, seen, ["user_id"], "ts", ["view_id", "viewed"]).select("event_id", "user_id", "view_id", "viewed")


_FOLLOWS = "SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR"


def clicks_and_purchases(events):
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").cast("timestamp").alias("clicked"))
    return clicks, events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").cast("timestamp").alias("bought"))


@query(_FOLLOWS)
def extra_J21_purchases_within_hours(spark, d):
    (events,) = load(spark, d, "events")
    return temporal.within(*clicks_and_purchases(events), ["user_id"], "clicked", "bought", 6 * 3600).select("user_id", "click_id", "purchase_id")


@query(_FOLLOWS)
def extra_J20_stream_of_purchases_within_hours(spark, d):
    """The same pairs from two streams of the events, whose state the watermark lets go."""
    (events,) = load(spark, d, "events")
    arrivals = materialize(events.select("event_id", "user_id", "event_type", "ts").repartitionByRange("ts"), "arrivals")
    stream = lambda: spark.readStream.schema(arrivals.schema).parquet(arrivals.stored_at)
    clicks, purchases = (side(stream()) for side in (lambda s: clicks_and_purchases(s)[0], lambda s: clicks_and_purchases(s)[1]))
    out = new_path(spark, "follows")
    run_table(spark, follows(clicks, purchases, "user_id", "clicked", "bought", 6 * 3600, "1 day"), out, new_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("user_id", "click_id", "purchase_id")
