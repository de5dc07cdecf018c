"""Configuration: strict sections with defaults, dotted overrides, optional YAML files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass
class Ingest:
    min_block_chars: int = 20
    chunk_size: int = 1200
    chunk_overlap: int = 200
    child_size: int = 0
    child_overlap: int = 50


@dataclass
class Retrieval:
    mode: str = "hybrid"
    sparse: str = "bm25"
    reranker: str | None = "overlap"
    fetch_k: int = 20
    rerank_k: int = 20
    top_k: int = 5
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75


@dataclass
class Agent:
    route: bool = False
    decompose: bool = True
    max_subqueries: int = 3
    retrieval_strategy: str = "single"
    max_hops: int = 2
    compression: str = "none"
    compress_sentences: int = 4
    crag: bool = False
    crag_threshold: float = 0.5
    crag_retries: int = 1
    min_relevance: float = 0.0
    verifier: str | None = "reranker"
    support_threshold: float = 0.05
    self_correct: bool = False
    self_correct_below: float = 0.5
    context: str = "chunk"
    context_window: int = 1
    context_chars: int = 4000


@dataclass
class Eval:
    ks: list[int] = field(default_factory=lambda: [1, 3, 5, 10])


@dataclass
class Config:
    ingest: Ingest = field(default_factory=Ingest)
    retrieval: Retrieval = field(default_factory=Retrieval)
    agent: Agent = field(default_factory=Agent)
    eval: Eval = field(default_factory=Eval)

    def __post_init__(self) -> None:
        if not 0 <= self.ingest.chunk_overlap < self.ingest.chunk_size:
            raise ValueError("ingest.chunk_overlap must be at least 0 and below chunk_size")
        if min(self.retrieval.fetch_k, self.retrieval.rerank_k, self.retrieval.top_k) < 1:
            raise ValueError("retrieval.fetch_k, rerank_k and top_k must be at least 1")
        for name, value, allowed in (
            ("retrieval.mode", self.retrieval.mode, {"sparse", "dense", "hybrid"}), ("retrieval.sparse", self.retrieval.sparse, {"bm25", "term_weights"}),
            ("agent.context", self.agent.context, {"chunk", "window", "section"}), ("agent.compression", self.agent.compression, {"none", "extractive"}),
            ("agent.retrieval_strategy", self.agent.retrieval_strategy, {"single", "iterative"}),
        ):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {sorted(allowed)}")


def _value(text: str) -> Any:
    """A scalar as YAML reads it."""
    plain = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in plain:
        return plain[text.lower()]
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def _merge(section: Any, values: dict, path: str = "") -> None:
    known = {f.name for f in fields(section)}
    for key, value in values.items():
        if key not in known:
            raise KeyError(f"unknown setting {path}{key}")
        if is_dataclass(getattr(section, key)):
            _merge(getattr(section, key), value, f"{path}{key}.")
        else:
            setattr(section, key, value)


def load_config(path: str | None = None, overrides: list[str] = ()) -> Config:
    """Defaults, then a YAML or JSON file if there is one, then key=value overrides with dotted keys."""
    config = Config()
    if path and Path(path).exists():
        text = Path(path).read_text()
        try:
            values = json.loads(text)
        except json.JSONDecodeError:
            import yaml

            values = yaml.safe_load(text) or {}
        _merge(config, values)
    for item in overrides:
        key, _, value = item.partition("=")
        nested: Any = _value(value)
        for part in reversed(key.split(".")):
            nested = {part: nested}
        _merge(config, nested)
    config.__post_init__()
    return config


def flat(config: Config) -> dict[str, Any]:
    """Dotted keys and values."""

    def walk(prefix: str, value: Any) -> dict[str, Any]:
        return {k: v for name, x in value.items() for k, v in walk(f"{prefix}.{name}" if prefix else name, x).items()} if isinstance(value, dict) else {prefix: value}

    return walk("", asdict(config))
