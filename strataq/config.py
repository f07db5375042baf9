"""Tunables of retrieval, chunking, context writing and limits."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    candidates: int = 40
    rrf_k: int = 60
    dense_weight: float = 0.5
    sparse_weight: float = 0.5
    identifier_weight: float = 0.6
    rerank_top_n: int = 10
    context_chunks: int = 8
    max_hops: int = 2
    mmr_lambda: float = 0.72
    neighbour_window: int = 1
    min_rerank_score: float = 0.015
    chunk_target: int = 500
    chunk_overlap: int = 64
    chunk_min: int = 48
    chunk_max: int = 900
    brief_chars: int = 12_000
    brief_window: int = 6_000
    context_batch: int = 28
    contextual: bool = True
    dimensions: int = 768
    cache_floor: float = 0.90
    budget_tokens: int = 12_000
    rerank_chars: int = 1_400
    daily_chunks: int = 600
    rate_seconds: int = 60

    def overridden(self, env: Mapping[str, str], prefix: str = "STRATAQ_") -> Settings:
        """With values from ``env``: numbers that aren't finite fall back, booleans are true unless "false" or "0"."""
        found: dict[str, object] = {}
        for f in fields(self):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            if isinstance(getattr(self, f.name), bool):
                found[f.name] = raw not in ("false", "0")
                continue
            try:
                value = float(raw)
            except ValueError:
                continue
            if math.isfinite(value):
                found[f.name] = type(getattr(self, f.name))(value)
        return replace(self, **found)


DEFAULTS = Settings()
