"""Question answering as a state machine over a batch of queries.

Every query is a row with the name of its next step.  A round runs each step that some row waits for, over just
those rows, and merges the step's delta into the row; rounds are bounded because rewrites and repairs are.  Model
calls happen in ``mapInPandas``; retrieval is a plan over the whole batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import EngineError, LLMProviderExhausted, LLMSchemaViolation, ValidationError
from ..shared import materialize
from ..schemas import STRATEGIES
from .models import LanguageModel, structured

STATE = "query_id string, next string, state string"
REFUSAL = "The sources found do not hold an answer, so this question cannot be answered from them."
NIL = str(uuid.UUID(int=0))
GROUPS = {  # steps that may run one after the other in one pass over the rows
    "guard": "front",
    "plan_route": "front",
    "rewrite_query": "front",
    "grade_context": "back",
    "generate": "back",
    "verify_citations": "back",
    "verify_grounded": "back",
    "repair": "back",
    "finalize": "back",
    "insufficient": "back",
}


def start(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, question[, strategy]) as waiting rows."""
    strategy = F.col("strategy") if "strategy" in queries.columns else F.lit(None).cast("string")
    first = F.struct(F.col("question"), F.col("question").alias("active_query"), strategy.alias("strategy_override"))
    return queries.select(F.col("query_id").cast("string").alias("query_id"), F.lit("guard").alias("next"), F.to_json(first).alias("state"))


class Machine:
    """The steps and their routes for one row; pickled to the executors."""

    def __init__(self, model: LanguageModel, settings: Settings):
        self.model, self.rules, self.limits = model, settings.orchestration, settings.limits

    # -- reducers ---------------------------------------------------------------------------------------------------
    def merge(self, state: dict, node: str, delta: dict) -> dict:
        out = dict(state)
        spent, used = out.get("spent") or {}, delta.pop("spent", None) or {}
        out["spent"] = {k: spent.get(k, 0) + used.get(k, 0) for k in ("llm_calls", "tokens")} | {"wall_ms": max(spent.get("wall_ms", 0), used.get("wall_ms", 0))}
        out["attempts"] = dict(out.get("attempts") or {})
        if node not in ("guard", "finalize", "insufficient"):
            out["attempts"][node] = out["attempts"].get(node, 0) + 1
        for key in ("failures", "degraded"):
            out[key] = [*(out.get(key) or []), *delta.pop(key, [])]
        return out | delta

    def exhausted(self, state: dict) -> bool:
        spent = state.get("spent") or {}
        return any(limit - spent.get(k, 0) <= 0 for k, limit in (("llm_calls", self.limits.max_llm_calls), ("tokens", self.limits.max_tokens), ("wall_ms", self.limits.max_wall_ms)))

    def failed_now(self, state: dict, node: str) -> bool:
        now = (state.get("attempts") or {}).get(node, 0)
        return now > 0 and any(f["node"] == node and f["attempt"] == now for f in state.get("failures") or [])

    def failure(self, state: dict, node: str, code: str, message: str) -> dict:
        return {"node": node, "code": code, "message": message, "attempt": (state.get("attempts") or {}).get(node, 0) + 1}

    def ask(self, role: str, request: dict, valid: Callable[[Any], bool]) -> tuple[Any, dict]:
        got = structured(self.model, role, request, valid, self.rules.max_repairs)
        return got["value"], {"llm_calls": got["repair_attempts"] + 1, "tokens": got["prompt_tokens"] + got["completion_tokens"], "wall_ms": got["latency_ms"]}

    # -- steps ------------------------------------------------------------------------------------------------------
    def guard(self, s: dict) -> dict:
        question = (s.get("question") or "").strip()
        if not question:
            raise ValidationError("the question is blank")
        if len(question) > self.limits.max_query_chars:
            raise ValidationError("the question is too long")
        return {"active_query": question}

    def plan_route(self, s: dict) -> dict:
        override = s.get("strategy_override")
        try:
            value, spent = self.ask("router", {"question": s["question"]}, lambda v: isinstance(v, dict) and v.get("strategy") in STRATEGIES)
        except LLMSchemaViolation as e:
            plan = {"strategy": override or self.rules.default_strategy, "template": "neighbors", "seed_entities": [], "hops": 1, "relation_type": None, "sub_queries": [], "rationale": "the router failed"}
            return {"plan": plan, "failures": [self.failure(s, "plan_route", e.code, str(e))]}
        plan = {"template": "neighbors", "seed_entities": [], "hops": 1, "relation_type": None, "sub_queries": [], "rationale": ""} | value
        return {"plan": plan | {"strategy": override or value["strategy"]}, "spent": spent}

    def rewrite_query(self, s: dict) -> dict:
        value, spent = self.ask("router", {"question": s["question"], "active_query": s["active_query"]}, lambda v: isinstance(v, dict) and isinstance(v.get("query"), str))
        return {"active_query": value["query"], "spent": spent}

    def grade_context(self, s: dict) -> dict:
        graded, failures, total = [], [], {"llm_calls": 0, "tokens": 0, "wall_ms": 0}
        chunks = s.get("fused") or []
        for a in range(0, len(chunks), self.rules.grade_batch):
            batch = chunks[a : a + self.rules.grade_batch]
            try:
                value, spent = self.ask("grader", {"question": s["question"], "chunks": batch}, lambda v: isinstance(v, dict) and isinstance(v.get("grades"), list))
                marks = {g["chunk_id"]: g["relevant"] for g in value["grades"]}
                if all(c["chunk_id"] in marks for c in batch):
                    graded += [c for c in batch if marks[c["chunk_id"]]]
                else:  # a batch with an unmentioned chunk is kept whole: a lost chunk cannot be made good later
                    graded += batch
                    failures.append(self.failure(s, "grade_context", "GRADES_INCOMPLETE", f"{len(value['grades'])} grades for {len(batch)} chunks"))
            except (LLMSchemaViolation, LLMProviderExhausted) as e:
                if not self.rules.fail_open:
                    raise
                graded, spent = graded + batch, {"llm_calls": 1, "tokens": 0, "wall_ms": 0}
                failures.append(self.failure(s, "grade_context", e.code, str(e)))
            total = {"llm_calls": total["llm_calls"] + spent["llm_calls"], "tokens": total["tokens"] + spent["tokens"], "wall_ms": max(total["wall_ms"], spent["wall_ms"])}
        return {"graded": graded, "spent": total, "failures": failures, "degraded": ["grader"] if failures else []}

    def generate(self, s: dict) -> dict:
        value, spent = self.ask("synth", {"question": s["question"], "chunks": s.get("graded") or []}, lambda v: isinstance(v, dict) and {"text", "citations", "confidence"} <= v.keys())
        known = {c["chunk_id"]: c for c in s.get("graded") or []}
        cited = []
        for c in value["citations"]:
            # ids that resolve to nothing stay: the next step is there to see them
            try:
                cid = str(uuid.UUID(c["chunk_id"])) if c["chunk_id"] not in known else c["chunk_id"]
            except ValueError:
                cid = NIL
            chunk = known.get(c["chunk_id"], {})
            cited.append({"chunk_id": cid, "doc_id": chunk.get("doc_id") or "", "uri": chunk.get("uri") or "", "quote": c.get("quote")})
        return {"answer": {"text": value["text"], "citations": cited, "confidence": value["confidence"]}, "spent": spent}

    def verify_citations(self, s: dict) -> dict:
        known = {c["chunk_id"] for c in s.get("graded") or []}
        wrong = [c["chunk_id"] for c in (s.get("answer") or {}).get("citations", []) if c["chunk_id"] not in known]
        return {"failures": [self.failure(s, "verify_citations", "CITATION_INVALID", f"cites ids outside its context: {', '.join(wrong)}")]} if wrong else {}

    def verify_grounded(self, s: dict) -> dict:
        if not s.get("answer"):
            return {}
        try:
            value, spent = self.ask("judge", {"answer": s["answer"]["text"], "chunks": s.get("graded") or []}, lambda v: isinstance(v, dict) and isinstance(v.get("score"), (int, float)))
        except LLMSchemaViolation as e:
            return {"failures": [self.failure(s, "verify_grounded", e.code, str(e))]}
        low = value["score"] < self.rules.min_groundedness
        return {"spent": spent, "failures": [self.failure(s, "verify_grounded", "UNGROUNDED_ANSWER", f"score {value['score']}")] if low else []}

    def repair(self, s: dict) -> dict:
        return {}

    def finalize(self, s: dict) -> dict:
        return {"refused": False}

    def insufficient(self, s: dict) -> dict:
        fused, graded = s.get("fused") or [], s.get("graded") or []
        reason = "no_retrieval" if not fused else "irrelevant_context" if not graded else "error" if s.get("failures") else "budget"
        cited = [{"chunk_id": c["chunk_id"], "doc_id": c["doc_id"], "uri": c.get("uri") or "", "quote": None} for c in graded or fused if c.get("doc_id")]
        return {"answer": {"text": REFUSAL, "citations": cited, "confidence": 1.0}, "refused": True, "refusal_reason": reason}

    # -- routes -----------------------------------------------------------------------------------------------------
    def route(self, node: str, s: dict) -> str:
        attempts = s.get("attempts") or {}
        if node == "guard":
            return "insufficient" if self.exhausted(s) else "plan_route"
        if node == "rewrite_query":
            return "plan_route"
        if node == "plan_route":
            return "retrieve"
        if node == "grade_context":
            if self.exhausted(s):
                return "insufficient"
            if len(s.get("graded") or []) >= self.rules.min_relevant:
                return "generate"
            return "insufficient" if attempts.get("rewrite_query", 0) >= self.rules.max_rewrites else "rewrite_query"
        if node == "generate":
            return "verify_citations"
        if node == "verify_citations":
            if self.failed_now(s, node):
                return "repair"
            if not self.rules.check_groundedness:
                return "finalize"
            return "insufficient" if self.exhausted(s) else "verify_grounded"
        if node == "verify_grounded":
            return "repair" if self.failed_now(s, node) else "finalize"
        if node == "repair":
            return "insufficient" if attempts.get("repair", 0) >= self.rules.max_repairs or self.exhausted(s) else "generate"
        return "end"

    def step(self, node: str, state: dict) -> tuple[str, dict]:
        try:
            state = self.merge(state, node, getattr(self, node)(state))
        except EngineError as e:
            return "error", state | {"error": {"code": e.code, "message": str(e)}}
        return self.route(node, state), state

    def advance(self, node: str, state: dict, group: str) -> tuple[str, dict]:
        """Run steps of one group until the row waits for another or ends."""
        while GROUPS.get(node) == group:
            node, state = self.step(node, state)
        return node, state


def run_node(node: str, model: LanguageModel, question: str, chunks: list[dict], settings: Settings | None = None, state: dict | None = None) -> tuple[str, dict]:
    """One step alone, for looking at it: (the step that would follow, the state after it).

    ``chunks`` are pinned: they count as found and as graded relevant.  ``state`` overrides what the step sees.
    """
    if node not in GROUPS:
        raise ValidationError(f"unknown step {node!r}", details={"known": sorted(GROUPS)})
    seen = {"question": question, "active_query": question, "fused": chunks, "graded": chunks} | (state or {})
    return Machine(model, settings or Settings()).step(node, seen)


def _advance(machine: Machine, group: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for q, node, state in zip(part["query_id"], part["next"], part["state"], strict=True):
                node, new = machine.advance(node, json.loads(state), group)
                rows.append((q, node, json.dumps(new)))
            yield pd.DataFrame(rows, columns=["query_id", "next", "state"])

    return run


Retrieve = Callable[[DataFrame], DataFrame]


def answer(queries: DataFrame, model: LanguageModel, retrieve: Retrieve, settings: Settings | None = None) -> DataFrame:
    """Final states: query_id, status (end or error), state as JSON.

    ``retrieve`` takes (query_id, active_query, plan as JSON) to (query_id, fused as JSON of chunks, degraded array)
    for each of its rows; queries that it leaves out have found nothing.
    """
    settings = settings or Settings()
    machine = Machine(model, settings)
    rows = start(queries)
    done = None
    for _ in range(settings.orchestration.max_rewrites + 1):
        rows = materialize(rows.mapInPandas(_advance(machine, "front"), STATE))
        waiting = rows.filter("next = 'retrieve'")
        asked = waiting.select("query_id", F.get_json_object("state", "$.active_query").alias("active_query"), F.get_json_object("state", "$.plan").alias("plan"))
        found = retrieve(asked).select("query_id", "fused", "degraded")
        joined = materialize(waiting.join(found, "query_id", "left"))

        def graft(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for q, state, fused, degraded in zip(part["query_id"], part["state"], part["fused"], part["degraded"], strict=True):
                    delta = {"fused": json.loads(fused) if fused else [], "degraded": list(degraded) if degraded is not None else []}
                    out.append((q, "grade_context", json.dumps(machine.merge(json.loads(state), "fuse", delta))))
                yield pd.DataFrame(out, columns=["query_id", "next", "state"])

        back = joined.select("query_id", "state", "fused", "degraded").mapInPandas(graft, STATE)
        back = back.unionByName(rows.filter("next = 'insufficient'")).mapInPandas(_advance(machine, "back"), STATE)
        back = materialize(back)
        ended = back.filter("next in ('end', 'error')").unionByName(rows.filter("next = 'error'"))
        done = ended if done is None else done.unionByName(ended)
        rows = back.filter("next = 'rewrite_query'")
        if rows.limit(1).count() == 0:
            break
    return done.select("query_id", F.col("next").alias("status"), "state")


def results(final: DataFrame) -> DataFrame:
    """Final states as columns; degraded markers distinct and sorted."""
    j = lambda p: F.get_json_object("state", p)
    cited = F.from_json(j("$.answer.citations"), "array<struct<chunk_id: string, doc_id: string, uri: string, quote: string>>")
    return final.select(
        "query_id",
        "status",
        j("$.answer.text").alias("answer"),
        j("$.answer.confidence").cast("double").alias("confidence"),
        F.transform(F.coalesce(cited, F.array().cast("array<struct<chunk_id: string, doc_id: string, uri: string, quote: string>>")), lambda c: c["chunk_id"]).alias("citations"),
        j("$.plan.strategy").alias("strategy"),
        F.coalesce(j("$.refused").cast("boolean"), F.lit(False)).alias("refused"),
        F.array_sort(F.array_distinct(F.coalesce(F.from_json(j("$.degraded"), "array<string>"), F.array().cast("array<string>")))).alias("degraded"),
        F.from_json(j("$.spent"), "llm_calls int, tokens int, wall_ms int").alias("spent"),
        j("$.error.code").alias("error"),
    )
