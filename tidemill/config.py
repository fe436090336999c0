"""Engine settings: frozen sections with checked invariants, layered from YAML, hashed without secrets."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import ValidationError


def need(condition: bool, message: str) -> None:
    if not condition:
        raise ValidationError(message)


@dataclass(frozen=True)
class Limits:
    max_query_chars: int = 2000
    max_upload_mb: int = 25
    allowed_mime: tuple[str, ...] = ("application/pdf", "text/plain", "text/markdown", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
    max_llm_calls: int = 12
    max_wall_ms: int = 45000
    max_tokens: int = 24000


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 900
    chunk_overlap: int = 150
    min_chunk_chars: int = 80

    def __post_init__(self):
        need(0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap must be below chunk_size")
        need(self.min_chunk_chars < self.chunk_size, "min_chunk_chars must be below chunk_size")


@dataclass(frozen=True)
class Embedding:
    model: str = "hash-384"
    dimensions: int = 384
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    batch_size: int = 64


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 20
    prefetch_limit: int = 50
    max_hops: int = 2
    max_paths: int = 40
    per_hop_cap: int = 25
    link_top_k: int = 5
    link_min_score: float = 0.72
    rrf_k: int = 60
    weight_vector: float = 1.0
    weight_graph: float = 1.0
    final_top_k: int = 10

    def __post_init__(self):
        need(1 <= self.max_hops <= 3, "max_hops must be from 1 to 3")
        need(self.final_top_k <= self.top_k, "final_top_k must not exceed top_k")
        need(self.rrf_k > 0, "rrf_k must be positive")


@dataclass(frozen=True)
class Resolution:
    block_k: int = 25
    weight_jaro_winkler: float = 0.30
    weight_token_set: float = 0.30
    weight_cosine: float = 0.40
    require_type_match: bool = True
    merge_at: float = 0.90
    reject_at: float = 0.65
    gray_action: str = "flag"
    max_cluster_size: int = 50
    # Words that do not tell entities apart.
    suffixes: tuple[str, ...] = ("inc", "inc.", "ltd", "ltd.", "llc", "corp", "corporation", "pvt", "private limited", "gmbh", "plc", "co", "co.")
    honorifics: tuple[str, ...] = ("mr", "mrs", "ms", "dr", "prof", "sir")

    def __post_init__(self):
        need(abs(self.weight_jaro_winkler + self.weight_token_set + self.weight_cosine - 1) < 1e-9, "scorer weights must sum to 1")
        need(self.reject_at < self.merge_at, "the reject threshold must be below the merge threshold")
        need(self.gray_action in ("flag", "ignore"), "gray pairs can be flagged or ignored")


@dataclass(frozen=True)
class Orchestration:
    default_strategy: str = "hybrid"
    min_relevant: int = 2
    max_rewrites: int = 2
    max_repairs: int = 2
    grade_batch: int = 8
    fail_open: bool = True
    check_groundedness: bool = True
    min_groundedness: float = 0.7
    extract_batch: int = 20


@dataclass(frozen=True)
class Roles:
    synth: str = "synth"
    judge: str = "judge"

    def __post_init__(self):
        need(self.synth != self.judge, "the judge must not be the model it judges")


@dataclass(frozen=True)
class Backoff:
    base_s: float = 2
    cap_s: float = 120
    honor_retry_after: bool = True


@dataclass(frozen=True)
class Trail:
    max_events: int = 500
    truncate_chars: int = 1500
    lookback_h: int = 24
    redact_keys: tuple[str, ...] = (r"api[_-]?key|token|secret|password|authorization",)


@dataclass(frozen=True)
class Evaluation:
    # The gates of a run.
    thresholds: tuple[tuple[str, float], ...] = (("recall_at_10", 0.70), ("faithfulness", 0.80), ("answer_relevancy", 0.75), ("routing_accuracy", 0.75), ("refusal_rate_on_unanswerable", 0.80))


@dataclass(frozen=True)
class Settings:
    limits: Limits = field(default_factory=Limits)
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    resolution: Resolution = field(default_factory=Resolution)
    orchestration: Orchestration = field(default_factory=Orchestration)
    roles: Roles = field(default_factory=Roles)
    backoff: Backoff = field(default_factory=Backoff)
    trail: Trail = field(default_factory=Trail)
    evaluation: Evaluation = field(default_factory=Evaluation)

    @property
    def digest(self) -> str:
        """SHA-256 of the settings as JSON with sorted keys; keys that name secrets are left out."""

        def plain(value: Any) -> Any:
            if isinstance(value, dict):
                return {k: plain(v) for k, v in value.items() if not any(s in k.lower() for s in ("secret", "password", "api_key"))}
            return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value

        return hashlib.sha256(json.dumps(plain(dataclasses.asdict(self)), sort_keys=True).encode()).hexdigest()


def merged(base: dict, over: dict) -> dict:
    """Maps merge key by key; anything else, lists included, is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_settings(*paths: str | Path) -> Settings:
    """Settings from YAML layers, later ones over earlier ones; an unknown section or key raises."""
    import yaml

    layers: dict = {}
    for path in paths:
        layers = merged(layers, yaml.safe_load(Path(path).read_text()) or {})
    sections = {f.name: f.default_factory for f in dataclasses.fields(Settings)}
    need(not set(layers) - set(sections), f"unknown sections: {sorted(set(layers) - set(sections))}")
    made = {}
    for name, values in layers.items():
        known = {f.name for f in dataclasses.fields(sections[name])}
        need(not set(values or {}) - known, f"unknown keys in {name}: {sorted(set(values or {}) - known)}")
        made[name] = sections[name](**{k: tuple(map(tuple, v.items())) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in (values or {}).items()})
    return Settings(**made)
