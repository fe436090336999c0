"""Retrieval, routing and refusal metrics of a golden set against results, and the gate on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of the distinct gold ids among the first k; 0 without gold."""
    hits = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    return F.when(F.size(gold) > 0, hits / F.size(F.array_distinct(gold))).otherwise(0.0)


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    at = F.filter(F.transform(retrieved, lambda r, i: F.when(F.array_contains(gold, r), i + 1)), lambda n: n.isNotNull())
    return F.when(F.size(gold) > 0, F.coalesce(F.lit(1.0) / F.get(at, F.lit(0)), F.lit(0.0))).otherwise(0.0)


def ndcg_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Binary gains over log2(rank + 1); the ideal has every distinct gold id first.  Repeats count each time."""
    gain = F.aggregate(F.transform(F.slice(retrieved, 1, k), lambda r, i: F.when(F.array_contains(gold, r), F.lit(1.0) / F.log2((i + 2).cast("double"))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size(F.array_distinct(gold)), F.lit(k))), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2((r + 1).cast("double")))
    return F.when(F.size(gold) > 0, gain / ideal).otherwise(0.0)


def item_metrics(golden: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """One row for each golden item with its result's metrics; items and results are matched by id."""
    none = F.array().cast("array<string>")
    both = golden.select("id", "category", "gold_route", F.coalesce("gold_chunk_ids", none).alias("gold"), "must_refuse").join(results.withColumnRenamed("item_id", "id").drop("category", "question"), "id", "left")
    got = F.coalesce("retrieved", none)
    return both.select("id", "category", "gold_route", "predicted_route", "must_refuse", "refused", (F.size("gold") > 0).alias("has_gold"), recall_at(got, F.col("gold"), k).alias("recall"), reciprocal_rank(got, F.col("gold")).alias("rr"), ndcg_at(got, F.col("gold"), k).alias("ndcg"))


def mean_or_zero(value: Column) -> Column:
    """Mean of the values that are neither null nor NaN, 0 without any."""
    return F.coalesce(F.avg(F.nanvl(value.cast("double"), F.lit(None).cast("double"))), F.lit(0.0))


def summary(items: DataFrame, k: int = 10) -> DataFrame:
    """One row of metrics: retrieval over items with gold, refusal over items that must refuse."""
    gold = lambda c: F.when(F.col("has_gold"), F.col(c))
    return items.agg(
        mean_or_zero(gold("recall")).alias(f"recall_at_{k}"),
        mean_or_zero(gold("rr")).alias("mrr"),
        mean_or_zero(gold("ndcg")).alias(f"ndcg_at_{k}"),
        mean_or_zero((F.col("predicted_route") == F.col("gold_route")).cast("int")).alias("routing_accuracy"),
        mean_or_zero(F.when(F.col("must_refuse"), F.coalesce(F.col("refused"), F.lit(False)).cast("int"))).alias("refusal_rate_on_unanswerable"),
    )


def by_category(items: DataFrame, k: int = 10) -> DataFrame:
    """Metrics over a category's items with gold, its count over all of them."""
    gold = lambda c: F.when(F.col("has_gold"), F.col(c))
    return items.groupBy("category").agg(mean_or_zero(gold("recall")).alias(f"recall_at_{k}"), mean_or_zero(gold("rr")).alias("mrr"), F.count("*").alias("count"))


def confusion(items: DataFrame, predicted: str = "predicted_route", gold: str = "gold_route") -> DataFrame:
    """(predicted, gold, n) for every pair of labels that occur on either side, zeros included."""
    labels = items.select(F.col(predicted).alias("l")).unionByName(items.select(F.col(gold).alias("l"))).filter("l is not null").distinct()
    counts = items.groupBy(F.col(predicted).alias("predicted"), F.col(gold).alias("gold")).agg(F.count("*").alias("n"))
    # one row each side for a label, of which there are few
    frame = labels.agg(F.collect_set("l").alias("ls")).select(F.explode("ls").alias("predicted"), "ls").select("predicted", F.explode("ls").alias("gold"))
    return frame.join(counts, ["predicted", "gold"], "left").select("predicted", "gold", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gate(metrics: DataFrame, thresholds: tuple[tuple[str, float], ...]) -> DataFrame:
    """(metric, score, threshold, passed): a metric that was not computed scores 0."""
    rows = [F.struct(F.lit(m).alias("metric"), (F.coalesce(F.col(m), F.lit(0.0)) if m in metrics.columns else F.lit(0.0)).alias("score"), F.lit(float(t)).alias("threshold")) for m, t in thresholds]
    return metrics.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("passed", F.col("score") >= F.col("threshold"))


def all_passed(gated: DataFrame) -> DataFrame:
    return gated.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def judge_means(scores: DataFrame, columns: list[str]) -> DataFrame:
    return scores.agg(*[mean_or_zero(F.col(c)).alias(c) for c in columns])


def context_recall(items: DataFrame, retrieved: str = "retrieved_texts", reference: str = "gold_texts", least: float = 0.5) -> DataFrame:
    """``items`` with context_recall: the share of reference texts that some retrieved text resembles.

    Likeness is 1 - edit distance / longer length; without reference texts there is no value.
    """
    like = lambda g, r: 1 - F.levenshtein(g, r) / F.greatest(F.length(g), F.length(r), F.lit(1))
    met = F.size(F.filter(reference, lambda g: F.exists(retrieved, lambda r: like(g, r) >= least)))
    return items.withColumn("context_recall", F.when(F.size(reference) > 0, F.coalesce(met, F.lit(0)) / F.size(reference)))


def kept_by_grade(rows: DataFrame, batch: list[str], grade: Column, relevant: Column) -> DataFrame:
    """Relevant rows of each batch; a batch in which any row lacks a grade (null) is kept whole, as a lost row cannot be made good."""
    graded = F.bool_and(grade.isNotNull()).over(Window.partitionBy(*batch))
    return rows.withColumn("_graded", graded).filter(~F.col("_graded") | relevant).drop("_graded")
