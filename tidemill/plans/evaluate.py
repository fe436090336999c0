"""Evaluation runs: a golden set through the state machine, its metrics, the gate, the report."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import ValidationError
from ..functions.scalars import is_refusal
from ..operators import evaluation as E
from ..shared import materialize
from ..sources.golden import subset as first_items
from ..sources.readers import Snapshots
from .models import LanguageModel
from .orchestrate import Retrieve, answer
from .orchestrate import results as as_rows

#: Seconds to wait before an item's second to fifth attempt, and the codes of errors that another attempt may mend.
WAITS = (15.0, 30.0, 60.0, 120.0)
MENDABLE = ("RATE_LIMITED", "LLM_PROVIDER_EXHAUSTED", "RETRIEVAL_BACKEND_UNAVAILABLE", "GRAPH_BACKEND_UNAVAILABLE")
RUNS = "run_id string, git_sha string, config_hash string, started_at timestamp, finished_at timestamp, metrics string"
RESULTS = "run_id string, item_id string, result string"


def as_results(finals: DataFrame) -> DataFrame:
    """Answers as result rows: retrieved ids are the answer's citations, a query without a route counts as vector."""
    text = F.coalesce("answer", F.lit(""))
    return finals.select(
        F.col("query_id").alias("item_id"),
        F.col("citations").alias("retrieved"),
        F.coalesce("strategy", F.lit("vector")).alias("predicted_route"),
        is_refusal(F.coalesce("confidence", F.lit(0.0)), text).alias("said_no"),
        F.col("refused").alias("refused"),
        F.col("error"),
    )


def run(golden: DataFrame, results: DataFrame, settings: Settings | None = None, k: int = 10) -> dict[str, DataFrame]:
    """Items, metrics, categories, confusion matrix and gate of a run."""
    settings = settings or Settings()
    items = E.item_metrics(golden, results, k)
    metrics = E.summary(items, k)
    return {"items": items, "metrics": metrics, "categories": E.by_category(items, k), "confusion": E.confusion(items), "gate": E.gate(metrics, settings.evaluation.thresholds)}


def to_markdown(report: dict[str, DataFrame]) -> str:
    """A report for reading; every table in it is small."""
    gate = report["gate"].orderBy("metric").collect()
    lines = ["# Evaluation", "", f"passed: {all(r['passed'] for r in gate)}", "", "| metric | score | threshold | passed |", "|---|---|---|---|"]
    lines += [f"| {r['metric']} | {r['score']:.4f} | {r['threshold']:.2f} | {r['passed']} |" for r in gate]
    lines += ["", "| category | recall | mrr | items |", "|---|---|---|---|"]
    lines += [f"| {r['category']} | {r[1]:.4f} | {r['mrr']:.4f} | {r['count']} |" for r in report["categories"].orderBy("category").collect()]
    lines += ["", "| predicted | gold | items |", "|---|---|---|"]
    lines += [f"| {r['predicted']} | {r['gold']} | {r['n']} |" for r in report["confusion"].orderBy("predicted", "gold").collect()]
    return "\n".join(lines)


def asked(golden: DataFrame, model: LanguageModel, retrieve: Retrieve, settings: Settings | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Every item through the state machine: item_id, answer, confidence, retrieved, predicted_route, refused, said_no, error.

    All items run in one batch.  Those that end in an error that another attempt may mend are asked again together, at
    most four times after growing waits; what then fails, or fails otherwise, is a row with its error.
    """
    settings = settings or Settings()
    open_items = golden.select(F.col("id").alias("query_id"), "question")
    done = None
    for pause in (0.0, *WAITS):
        if pause:
            wait(pause)
        rows = materialize(as_rows(answer(open_items, model, retrieve, settings)), "answers")
        again = F.coalesce(F.col("error").isin(*MENDABLE), F.lit(False)) if pause != WAITS[-1] else F.lit(False)
        ended = rows.filter(~again)
        done = ended if done is None else done.unionByName(ended)
        open_items = golden.select(F.col("id").alias("query_id"), "question").join(rows.filter(again).select("query_id"), "query_id", "left_semi")
        if not rows.filter(again).limit(1).count():
            break
    given = done.select("query_id", "answer", "confidence")
    return as_results(done).join(given, F.col("item_id") == F.col("query_id")).drop("query_id")


Judge = Callable[[DataFrame], DataFrame]


@dataclass
class Report:
    """What a run found; ``tables`` are those of ``run``."""

    run_id: str
    metrics: dict[str, float]
    passed: bool
    models_served: list[str]
    tables: dict[str, DataFrame] = field(repr=False)

    @property
    def mixed_judges(self) -> bool:
        return len(set(self.models_served)) > 1


class EvalStore:
    """Runs and their items, appended to a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Snapshots(spark, folder)

    def save_run(self, run_id: str, git_sha: str, config: str, started_at: datetime, finished_at: datetime, metrics: dict) -> None:
        self.store.append("eval_runs", self.spark.createDataFrame([(run_id, git_sha, config, started_at, finished_at, json.dumps(metrics, sort_keys=True))], RUNS))

    def save_results(self, run_id: str, rows: DataFrame, key: str = "item_id") -> None:
        """Each row of a run as JSON under its item."""
        self.store.append("eval_results", rows.select(F.lit(run_id).alias("run_id"), F.col(key).cast("string").alias("item_id"), F.to_json(F.struct(*rows.columns)).alias("result")))

    def get_run(self, run_id: str) -> dict | None:
        rows = self.spark.read.schema(RUNS).parquet(f"{self.store.folder}/eval_runs").filter(F.col("run_id") == run_id).limit(1).collect()
        return {**rows[0].asDict(), "metrics": json.loads(rows[0]["metrics"])} if rows else None

    def get_results(self, run_id: str) -> DataFrame:
        return self.spark.read.schema(RESULTS).parquet(f"{self.store.folder}/eval_results").filter(F.col("run_id") == run_id)


def evaluate(golden: DataFrame, model: LanguageModel, retrieve: Retrieve, settings: Settings | None = None, judge: Judge | None = None, store: EvalStore | None = None, subset: int | None = None, git_sha: str = "", wait: Callable[[float], None] = time.sleep) -> Report:
    """Run a golden set: ask, score, judge, hold against the gate, store.

    ``judge`` takes the items with their answers to (item_id, one column a metric, and optionally model_served); its
    metrics are means without NaN.  A judge that served several models makes a mixed run.
    """
    settings = settings or Settings()
    began, run_id = datetime.now(UTC), str(uuid.uuid4())
    items = golden if subset is None else first_items(golden, subset)
    found = materialize(asked(items, model, retrieve, settings, wait), "results")
    report = run(items, found, settings)
    served: list[str] = []
    if judge is not None:
        scores = materialize(judge(items.join(found, F.col("id") == F.col("item_id"))), "judged")
        names = [c for c in scores.columns if c not in ("item_id", "model_served")]
        if not names:
            raise ValidationError("the judge gave no metric")
        report["metrics"] = report["metrics"].join(F.broadcast(E.judge_means(scores, names)))  # one row each
        report["gate"] = E.gate(report["metrics"], settings.evaluation.thresholds)
        if "model_served" in scores.columns:
            served = sorted(r[0] for r in scores.select("model_served").distinct().collect() if r[0] is not None)
    metrics = report["metrics"].first().asDict()
    passed = E.all_passed(report["gate"]).first()["passed"]
    if store is not None:
        store.save_run(run_id, git_sha, settings.digest, began, datetime.now(UTC), metrics)
        store.save_results(run_id, found)
    return Report(run_id, metrics, passed, served, report)
