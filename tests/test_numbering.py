"""Numbers over whole tables, against SQL's row_number."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators.numbering import positions, running_totals


@pytest.fixture
def rows(spark):
    return spark.range(5000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") % 50 == 1, F.lit("rare")).otherwise(F.lit("hot"))).alias("kind"),
        F.xxhash64("id").alias("key"),
    )


def test_global_number(rows):
    found = {r["id"]: r["position"] for r in positions(rows, ["key"]).collect()}
    wanted = [r["id"] for r in sorted(rows.collect(), key=lambda r: r["key"])]
    assert [found[i] for i in wanted] == list(range(5000))


def test_number_within_groups_counts_null_as_a_group(rows):
    found = {r["id"]: r["position"] for r in positions(rows, [F.desc("key")], ["kind"], "at").withColumnRenamed("at", "position").collect()}
    for kind in (None, "hot", "rare"):
        own = [r["id"] for r in sorted(rows.collect(), key=lambda r: -r["key"]) if r["kind"] == kind]
        assert [found[i] for i in own] == list(range(len(own)))


def test_ties_get_each_number_once_and_empty_tables_none(spark, rows):
    tied = positions(rows.withColumn("key", F.lit(1)), ["key"])
    assert sorted(r["position"] for r in tied.collect()) == list(range(5000))
    assert positions(rows.limit(0), ["key"], ["kind"]).count() == 0


def test_no_window_holds_a_group(rows):
    plan = positions(rows, ["key"], ["kind"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert "row_number" not in plan


def test_running_totals(spark, rows):
    summed = running_totals(rows.withColumn("v", F.when(F.col("id") % 7 != 0, F.col("id"))), "v", ["key"], ["kind"])
    found = {r["id"]: r["total"] for r in summed.collect()}
    for kind in (None, "hot", "rare"):
        total = 0
        for r in sorted((r for r in rows.collect() if r["kind"] == kind), key=lambda r: r["key"]):
            total += r["id"] if r["id"] % 7 else 0
            assert found[r["id"]] == total
