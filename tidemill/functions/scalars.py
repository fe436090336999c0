"""Small expressions: keys, times, levels, refusals, budgets, counters, redaction."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import Backoff, Embedding, Limits, Trail
from .identity import UNIT_SEPARATOR

# Phrases that mark a refusal, and beginnings of secret values.
REFUSALS = ("cannot", "don't have", "no information", "not available", "unable to")
SECRET_PREFIXES = ("sk-", "gsk_", "AIza")
REDACTED = "**********"
REDACT_DEPTH = 6


def retrieval_cache_key(query: Column, top_k: Column, settings_digest: str, corpus_version: Column, prefix: str = "ret:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws(UNIT_SEPARATOR, query, top_k.cast("string"), F.lit(settings_digest), corpus_version.cast("string")), 256))


def embedding_cache_key(text: Column, model: str, prefix: str = "emb:") -> Column:
    return F.concat(F.lit(f"{prefix}{model}:"), F.sha2(text, 256))


def query_text(query: Column, embedding: Embedding) -> Column:
    """What is embedded for a query (a passage is embedded as it is)."""
    return F.concat(F.lit(embedding.query_prefix), query)


def is_refusal(confidence: Column, text: Column) -> Column:
    said = F.lit(False)
    for phrase in REFUSALS:
        said = said | F.contains(F.lower(text), F.lit(phrase))
    return (confidence < 0.3) | said


def epoch_ns(ns: Column) -> Column:
    return F.timestamp_micros(F.floor(ns.cast("decimal(38,0)") / 1000).cast("long"))


def status_level(code: Column) -> Column:
    return F.when(code.cast("string").isin("2", "STATUS_CODE_ERROR"), "ERROR").otherwise("INFO")


def backoff_s(attempt: Column, retry_after: Column, rules: Backoff) -> Column:
    grown = F.least(F.lit(float(rules.base_s)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(float(rules.cap_s)))
    return F.when(retry_after.isNotNull(), F.least(retry_after.cast("double"), F.lit(float(rules.cap_s)))).otherwise(grown) if rules.honor_retry_after else grown


def valid_question(text: Column, limits: Limits) -> Column:
    """Neither blank nor longer than a question may be."""
    return F.coalesce((F.trim(text) != "") & (F.length(text) <= limits.max_query_chars), F.lit(False))


def total_spent(calls: Column, tokens: Column, wall_ms: Column) -> list[Column]:
    """``merge_spent`` over a group: sums, and the longest time."""
    return [F.sum(calls).alias("llm_calls"), F.sum(tokens).alias("tokens"), F.max(wall_ms).alias("wall_ms")]


def remaining(spent: Column, limits: Limits) -> Column:
    left = lambda limit, key: F.greatest(F.lit(0), F.lit(limit) - spent[key])
    return F.struct(left(limits.max_llm_calls, "llm_calls").alias("llm_calls"), left(limits.max_tokens, "tokens").alias("tokens"), left(limits.max_wall_ms, "wall_ms").alias("wall_ms"))


def exhausted(spent: Column, limits: Limits) -> Column:
    r = remaining(spent, limits)
    return (r["llm_calls"] <= 0) | (r["tokens"] <= 0) | (r["wall_ms"] <= 0)


def breach(spent: Column, limits: Limits) -> Column:
    """The first limit that is exceeded, or null."""
    return F.when(spent["llm_calls"] > limits.max_llm_calls, "llm_calls").when(spent["wall_ms"] > limits.max_wall_ms, "wall_ms").when(spent["tokens"] > limits.max_tokens, "tokens")


def merge_spent(a: Column, b: Column) -> Column:
    """Calls and tokens add up; wall time is the longest, as branches run side by side."""
    return F.struct((a["llm_calls"] + b["llm_calls"]).alias("llm_calls"), (a["tokens"] + b["tokens"]).alias("tokens"), F.greatest(a["wall_ms"], b["wall_ms"]).alias("wall_ms"))


def merge_counters(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def failed_on_current_attempt(failures: Column, attempts: Column, node: str) -> Column:
    """Whether the node's latest run, and not some earlier one, failed."""
    now = F.coalesce(F.element_at(attempts, F.lit(node)), F.lit(0))
    return (now > 0) & F.exists(failures, lambda f: (f["node"] == node) & (f["attempt"] == now))


def redact_map(attributes: Column, rules: Trail) -> Column:
    """Values whose key names a secret, or that look like one."""
    keys = "(?i)" + "|".join(f"(?:{p})" for p in rules.redact_keys)
    looks = F.lit(False)
    return F.transform_values(attributes, lambda k, v: F.when(k.rlike(keys) | F.coalesce(_secret(v), looks), F.lit(REDACTED)).otherwise(v))


def _secret(value: Column) -> Column:
    out = F.lit(False)
    for p in SECRET_PREFIXES:
        out = out | value.startswith(p)
    return out


def redacted(value, pattern: re.Pattern, depth: int = 0):
    """Nested values with their secrets covered, down to a depth that bounds the cost."""
    if depth > REDACT_DEPTH:
        return value
    if isinstance(value, dict):
        return {k: REDACTED if pattern.search(str(k)) else redacted(v, pattern, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, pattern, depth + 1) for v in value]
    return REDACTED if isinstance(value, str) and value.startswith(SECRET_PREFIXES) else value


def redact_json(text: Column, rules: Trail) -> Column:
    """``redacted`` for JSON objects of any shape; texts that are no JSON stay."""
    keys = "|".join(f"(?:{p})" for p in rules.redact_keys)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        pattern = re.compile(keys, re.I)

        def one(t):
            try:
                return None if t is None else json.dumps(redacted(json.loads(t), pattern), ensure_ascii=False)
            except ValueError:
                return t

        return texts.map(one)

    return run(text)
