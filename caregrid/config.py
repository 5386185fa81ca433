"""Run parameters as one frozen dataclass (defaults follow the reference settings)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # geo ranking (composite = w_dist * exp(-d / decay_km) + w_trust * trust + w_cap * cap)
    decay_km: float = 15.0
    max_radius_km: float = 100.0
    w_dist: float = 0.35
    w_trust: float = 0.35
    w_cap: float = 0.30
    travel_kmh: float = 30.0
    # deserts
    desert_threshold: float = 0.10
    desert_high_risk: float = 0.70
    # reasoning / vector search
    min_trust_for_reasoning: float = 0.4
    vector_top_k: int = 20
    reasoning_top_k: int = 5
    overfetch: int = 4
    # self-correction
    low_trust_threshold: float = 0.65
    max_correction_iterations: int = 2
    # bytes of query vectors (rows x dimensions x 8) that may be broadcast; larger batches go in blocks
    max_broadcast_bytes: int = 64_000_000
    block_queries: int = 8192


DEFAULT = Params()
