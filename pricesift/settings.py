"""Tunables (one frozen object, passed to operators that need it)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Fixed values that must equal the reference's for equal results.
    duplicate_threshold: float = 0.85          # name similarity must exceed this
    price_variance_threshold: float = 0.1      # price similarity must exceed 1 - this
    group_threshold: float = 0.8               # leader similarity for product groups
    is_duplicate_threshold: float = 0.85
    is_duplicate_price_variance: float = 0.15  # above this the threshold rises by 0.05
    min_score: float = 0.3                     # vector hit floor
    enhance_gate: float = 0.5                  # best hit must exceed this to enhance
    top_k: int = 3
    history_keep: int = 30
    default_reliability: float = 0.6
    free_shipping_bonus: bool = False          # the reference can never award it
    max_results_default: int = 50
    # Block sizes for the exact vector search grid (rows per block).
    knn_doc_block_rows: int = 20000
    knn_query_block_rows: int = 2000
    # Per-query rank through a range-partitioned sort (splits hot queries).
    skew_safe_rank: bool = True
    # Row bound under which a derived small table (checked by count) is broadcast.
    broadcast_max_rows: int = 1_000_000
    weights: dict = field(default_factory=lambda: {
        "fuzzy": 0.3, "brand": 0.25, "model": 0.2, "storage": 0.1,
        "color": 0.05, "query_relevance": 0.1,
    })


DEFAULT = Settings()
