"""Settings of build and retrieval, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.splitters import Splitter


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 10
    graph_weight: float = 0.6
    entity_weight: float = 0.4
    recall_multiplier: int = 3
    rrf_k: int = 60
    anchors: int = 2
    hops: int = 4
    context_tokens: int = 7000
    chunks_per_node: int = 6
    chain_length: int = 5
    gap_top_k: int = 20
    supplement_top_k: int = 150
    supplement_least: int = 100
    keyword_threshold: float = 0.5
    keyword_top_k: int = 5
    strategy: str = "full_context"
    gap_in_context: bool = False  # Q-15
    any_anchor_sufficient: bool = True  # Q-16

    def __post_init__(self):
        if min(self.top_k, self.anchors, self.hops, self.context_tokens, self.chunks_per_node) < 1:
            raise ValueError("top_k, anchors, hops, context_tokens and chunks_per_node must be at least 1")
        if self.strategy not in ("full_context", "step_by_step"):
            raise ValueError(f"unknown strategy: {self.strategy}")


@dataclass(frozen=True)
class BuildConfig:
    splitter: Splitter = field(default_factory=lambda: Splitter("paragraph"))
    method: str = "residual"
    gamma: float = 0.5
    hops: int = 2
    mounts_per_node: int = 6
    keywords_per_chunk: int = 5
    diversity: float = 0.3

    def __post_init__(self):
        if not 0 < self.gamma <= 1 or self.hops < 1:
            raise ValueError("gamma must be above 0 and at most 1, hops at least 1")
        if self.mounts_per_node < 1 or self.keywords_per_chunk < 1:
            raise ValueError("mounts_per_node and keywords_per_chunk must be at least 1")
