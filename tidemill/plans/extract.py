"""Mentions and relations that a model reads out of chunks, kept only where the chunk bears them out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Orchestration
from ..errors import EngineError
from ..operators.chunking import batched
from .models import LanguageModel, structured

RAW = "kind string, chunk_id string, surface string, type string, char_start int, char_end int, dst_surface string, confidence double, evidence_span string, error string"


def valid_mentions(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mentions of known chunks whose span lies inside the text."""
    known = mentions.join(chunks.select("chunk_id", F.length("text").alias("_n")), "chunk_id")
    return known.filter("0 <= char_start and char_start < char_end and char_end <= _n").drop("_n")


def valid_relations(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    return relations.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def extract(chunks: DataFrame, model: LanguageModel, rules: Orchestration | None = None, group: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``chunks`` (group, chunk_id, ord, text): (mentions, relations, errors), one model call for a batch of chunks."""
    rules = rules or Orchestration()
    numbered = batched(chunks, [group], ["ord", "chunk_id"], rules.extract_batch)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        items = [{"chunk_id": c, "text": t} for c, t in zip(part["chunk_id"], part["text"], strict=True)]
        try:
            got = structured(model, "bulk", {"chunks": items}, lambda v: isinstance(v, dict) and {"mentions", "relations"} <= v.keys(), rules.max_repairs)["value"]
            rows += [{"kind": "mention", **m} for m in got["mentions"]]
            rows += [{"kind": "relation", "surface": r["src_surface"], **{k: v for k, v in r.items() if k != "src_surface"}} for r in got["relations"]]
        except EngineError as e:
            rows += [{"kind": "error", "chunk_id": i["chunk_id"], "error": e.code} for i in items]
        names = [c.split()[0] for c in RAW.split(", ")]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype="Int32" if n.startswith("char_") else "float64" if n == "confidence" else "object") for n in names})

    raw = numbered.groupBy(group, "batch").applyInPandas(run, RAW)
    mentions = raw.filter("kind = 'mention'").select("chunk_id", "surface", "type", "char_start", "char_end", "confidence", F.lit(None).cast("string").alias("entity_id"))
    relations = raw.filter("kind = 'relation'").select("chunk_id", F.col("surface").alias("src_surface"), "dst_surface", "type", "confidence", "evidence_span")
    return valid_mentions(mentions, chunks), valid_relations(relations, chunks), raw.filter("kind = 'error'").select("chunk_id", "error")
