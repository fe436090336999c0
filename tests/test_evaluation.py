import math

import pytest
from pyspark.sql import functions as F

from tidemill.config import Settings, load_settings, merged
from tidemill.errors import InternalError, RateLimited, ValidationError, envelope_of
from tidemill.functions import scalars
from tidemill.operators import evaluation as E
from tidemill.plans.evaluate import run, to_markdown
from tidemill.schemas import GOLDEN
from tidemill.sources.golden import load_golden, subset

CASES = [(["a", "b", "c"], ["b"], 10, 1, 1 / 2, 1 / math.log2(3)), (["a", "b", "c"], ["a", "c"], 2, 1 / 2, 1, 1 / (1 + 1 / math.log2(3))), ([], ["a"], 10, 0, 0, 0), (["a"], [], 10, 0, 0, 0)]


@pytest.mark.parametrize(("got", "gold", "k", "recall", "rr", "ndcg"), CASES)
def test_hand_computed(spark, got, gold, k, recall, rr, ndcg):
    row = spark.createDataFrame([(got, gold)], "r array<string>, g array<string>").select(E.recall_at(F.col("r"), F.col("g"), k), E.reciprocal_rank(F.col("r"), F.col("g")), E.ndcg_at(F.col("r"), F.col("g"), k)).first()
    assert [round(v, 9) for v in row] == [round(v, 9) for v in (recall, rr, ndcg)]


def test_report(spark):
    golden = spark.createDataFrame([("1", "q", "single", "vector", ["a"], None, False), ("2", "q", "multi", "graph", ["b"], None, False), ("3", "q", "none", "hybrid", None, None, True)], GOLDEN)
    results = spark.createDataFrame([("1", ["a"], "vector", False), ("2", ["x", "b"], "vector", False), ("3", [], "hybrid", True)], "item_id string, retrieved array<string>, predicted_route string, refused boolean")
    report = run(golden, results, Settings())
    m = report["metrics"].first()
    assert (m.recall_at_10, m.mrr, round(m.routing_accuracy, 6), m.refusal_rate_on_unanswerable) == (1.0, 0.75, 0.666667, 1.0)
    cells = {(r.predicted, r.gold): r.n for r in report["confusion"].collect()}
    assert len(cells) == 9 and cells["vector", "vector"] == cells["vector", "graph"] == 1 and cells["graph", "graph"] == 0
    gates = {r.metric: r.passed for r in report["gate"].collect()}
    assert gates == {"recall_at_10": True, "faithfulness": False, "answer_relevancy": False, "routing_accuracy": False, "refusal_rate_on_unanswerable": True}
    assert not E.all_passed(report["gate"]).first()[0]
    assert "| recall_at_10 | 1.0000 | 0.70 | True |" in to_markdown(report)


def test_judge_means_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (0.0,)], "f double")
    assert E.judge_means(df, ["f"]).first()[0] == 0.5 and E.judge_means(df.filter("f > 5"), ["f"]).first()[0] == 0.0


def test_golden_files(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("- {id: 2, question: q, category: c, gold_route: graph, gold_chunk_ids: null, must_refuse: true}\n")
    (tmp_path / "a.yaml").write_text("- {id: 1, question: q, category: c, gold_route: vector, gold_chunk_ids: [x]}\n")
    golden = load_golden(spark, str(tmp_path))
    assert [(r.id, r.gold_chunk_ids, r.must_refuse) for r in golden.orderBy("pos").collect()] == [("1", ["x"], False), ("2", [], True)]
    assert subset(golden, 1).count() == 1
    (tmp_path / "c.yaml").write_text("id: 1\n")
    for bad in (str(tmp_path), str(tmp_path / "missing")):
        with pytest.raises(ValidationError):
            load_golden(spark, bad)


def test_settings(tmp_path):
    assert merged({"a": {"x": 1, "y": [1]}, "b": 2}, {"a": {"y": [2]}, "c": 3}) == {"a": {"x": 1, "y": [2]}, "b": 2, "c": 3}
    one, two = tmp_path / "1.yaml", tmp_path / "2.yaml"
    one.write_text("chunking: {chunk_size: 500, chunk_overlap: 100}\n")
    two.write_text("chunking: {chunk_overlap: 50}\nlimits: {max_query_chars: 10}\n")
    s = load_settings(one, two)
    assert (s.chunking.chunk_size, s.chunking.chunk_overlap, s.limits.max_query_chars) == (500, 50, 10)
    assert s.digest != Settings().digest == Settings().digest
    for text in ("nothing: {a: 1}", "limits: {nothing: 1}", "chunking: {chunk_overlap: 900}", "retrieval: {max_hops: 4}", "resolution: {weight_cosine: 0.5}", "resolution: {gray_action: ask}", "roles: {judge: synth}", "retrieval: {final_top_k: 30}"):
        one.write_text(text)
        with pytest.raises(ValidationError):
            load_settings(one)


def test_errors():
    e = RateLimited("slow", retry_after=3, details={"a": 1})
    assert e.retryable and e.status == 429 and e.envelope()["error"] == {"code": "RATE_LIMITED", "message": "slow", "details": {"a": 1}}
    assert envelope_of(KeyError("secret"))["error"] == {"code": InternalError.code, "message": "internal error", "details": {}}


def test_spend_and_redaction(spark):
    import re

    a, b = (F.struct(*[F.lit(v).alias(k) for k, v in zip(("llm_calls", "tokens", "wall_ms"), t, strict=True)]) for t in ((1, 10, 5), (2, 20, 3)))
    one = spark.range(1).select(scalars.merge_spent(a, b).alias("x"), scalars.merge_spent(b, a).alias("y")).first()
    assert one.x == one.y and tuple(one.x) == (3, 30, 5)
    nested = {"ok": [{"api_key": 1, "note": "sk-1"}], "Authorization": "x"}
    for _ in range(8):
        nested = {"deep": nested}
    pattern = re.compile("api[_-]?key|authorization", re.I)
    covered = scalars.redacted({"ok": [{"api_key": 1, "note": "sk-1"}], "Authorization": "x", "plain": "y"}, pattern)
    assert covered == {"ok": [{"api_key": scalars.REDACTED, "note": scalars.REDACTED}], "Authorization": scalars.REDACTED, "plain": "y"}
    assert scalars.redacted(nested, pattern) == nested  # beyond the depth that is looked at
