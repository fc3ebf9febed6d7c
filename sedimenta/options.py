"""Engine options with their defaults, and how they are read from text (environment variables or a CLI)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    chunk_target_chars: int = 2200
    chunk_overlap_chars: int = 250
    table_row_window: int = 6
    code_line_window: int = 80
    code_line_overlap: int = 10
    dense_candidate_count: int = 20
    sparse_candidate_count: int = 20
    graph_candidate_count: int = 20
    graph_enabled: bool = True
    graph_neighbor_limit: int = 10
    graph_fact_limit: int = 8
    graph_fusion_weight: float = 0.4
    graph_document_boost: float = 0.3
    rerank_candidate_count: int = 20
    final_context_count: int = 5
    auto_ingest_on_start: bool = False
    embed_batch: int = 16
    recall_k: int = 5
    ranking_k: int = 10
    #: Rows of a join side up to which it is broadcast.
    broadcast_rows: int = 200_000

    def __post_init__(self):
        if self.chunk_overlap_chars >= self.chunk_target_chars or self.code_line_overlap >= self.code_line_window:
            raise ValueError("an overlap must be smaller than its window")

    @classmethod
    def from_env(cls, prefix: str = "SEDIMENTA_", env: dict[str, str] | None = None) -> Options:
        """Options named PREFIX + FIELD in env; 1, true, yes and on are true. Bad numbers raise."""
        env, out = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                out[f.name] = raw.strip().lower() in {"1", "true", "yes", "on"} if kind is bool else kind(raw)
        return replace(cls(), **out)
