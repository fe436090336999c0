"""Joins in time and sketches against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from tidemill.operators import sketches, temporal
from tidemill.streaming.joins import follows, run_table

START = datetime.datetime(2026, 1, 1)
LEFT, RIGHT = "k string, at timestamp, id int", "k string, at timestamp, v int"


def made(n, seed, keys=("hot", "hot", "hot", "cold", None)):
    rng = random.Random(seed)
    return [(rng.choice(keys), START + datetime.timedelta(minutes=rng.randrange(6000)) if rng.random() > 0.02 else None, i) for i in range(n)]


def test_last_before_over_days_with_ties_and_nulls(spark):
    left, right = made(300, 1), made(200, 2)
    right += [("hot", START, 900), ("hot", START, 901)]
    found = temporal.last_before(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "at", ["v"], tie=["v"], seconds=7200)
    got = {r.id: r.v for r in found.collect()}
    for k, at, i in left:
        able = [(t, v) for kk, t, v in right if k is not None and kk == k and at is not None and t is not None and t <= at]
        assert got[i] == (max(able)[1] if able else None), (k, at, i)
    assert len(got) == len(left)


def test_within_equals_all_pairs(spark):
    left, right = made(200, 3), made(200, 4)
    a = spark.createDataFrame(left, "k string, at timestamp, id int")
    b = spark.createDataFrame(right, "k string, then timestamp, v int")
    got = sorted((r.id, r.v) for r in temporal.within(a, b, ["k"], "at", "then", 3600).collect())
    want = sorted((i, v) for k, at, i in left for kk, t, v in right if k is not None and k == kk and at and t and 0 <= (t - at).total_seconds() <= 3600)
    assert got == want and want
    plan = temporal.within(a, b, ["k"], "at", "then", 3600)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_two_streams_meet_as_tables_do_and_late_rows_are_counted(spark, tmp_path):
    paths = {n: f"file://{tmp_path}/{n}" for n in ("a", "b", "out", "check")}
    left, right = [r for r in made(150, 5) if r[0] and r[1]], [r for r in made(150, 6) if r[0] and r[1]]
    a, b = spark.createDataFrame(left, "k string, at timestamp, id int"), spark.createDataFrame(right, "k string, then timestamp, v int")
    a.coalesce(1).write.parquet(paths["a"])
    b.coalesce(1).write.parquet(paths["b"])

    def run():
        streams = (spark.readStream.schema(t.schema).parquet(paths[n]) for n, t in (("a", a), ("b", b)))
        return run_table(spark, follows(*streams, "k", "at", "then", 3600, "1 hour"), paths["out"], paths["check"])

    assert run() == 0
    told = lambda df: sorted((r.id, r.v) for r in df.collect())
    both = told(spark.read.parquet(paths["out"]))
    assert both == told(follows(a, b, "k", "at", "then", 3600, "1 hour")) and both
    # rows from long before what has been seen
    spark.createDataFrame([("hot", START, 999), ("hot", START, 998)], "k string, at timestamp, id int").coalesce(1).write.mode("append").parquet(paths["a"])
    assert run() == 2
    assert told(spark.read.parquet(paths["out"])) == both


def test_sketches_of_days_merge(spark):
    rows = spark.range(20_000).select(F.timestamp_seconds(F.col("id") * 60).alias("at"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(1000))).alias("v"), (F.col("id") % 500).alias("who"))
    daily = sketches.daily(rows, "at", "g", "v", "who")
    assert daily.count() == 2 * 14
    whole = sketches.merged(daily, ["g"])
    exact = {r.g: (r.n, r.total) for r in rows.groupBy("g").agg(F.count("v").alias("n"), F.sum(F.col("v").cast("double")).alias("total")).collect()}
    assert {r.g: (r.n, r.total) for r in whole.collect()} == exact
    for r in sketches.quantiles(whole, [0.05, 0.5, 0.95]).collect():
        rank = rows.filter((F.col("g") == r.g) & F.col("v").isNotNull()).agg(F.avg((F.col("v") <= r.estimate).cast("double"))).first()[0]
        assert abs(rank - r.q) <= sketches.RANK_ERROR
    assert all(abs(r.n - 500) <= 500 * sketches.COUNT_ERROR for r in whole.select(sketches.distinct_of("who").alias("n")).collect())
