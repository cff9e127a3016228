"""Settings with the defaults that retrieval and dialogue operators use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults, and below the bounds of each.
    chunk_tokens: int = 320
    chunk_overlap_tokens: int = 48
    contextualize: bool = False
    candidates_per_retriever: int = 30
    rerank_candidates: int = 40
    top_k: int = 6
    rrf_k: int = 60
    weight_dense: float = 1.0
    weight_lexical: float = 1.0
    weight_sparse: float = 1.0
    mmr_lambda: float = 0.75
    window: int = 1
    min_relevance: float = 0.02
    query_expansion: bool = True
    max_retrieval_rounds: int = 2
    max_upload_mb: int = 25
    bm25_k1: float = 1.2
    bm25_b: float = 0.75

    def __post_init__(self) -> None:
        bounds = {
            "chunk_tokens": (64, 2048), "chunk_overlap_tokens": (0, 512), "candidates_per_retriever": (1, 500), "rerank_candidates": (1, 200),
            "top_k": (1, 30), "mmr_lambda": (0, 1), "window": (0, 3), "min_relevance": (0, 1), "max_retrieval_rounds": (1, 3),
        }
        for name, (low, high) in bounds.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")

    def weight(self, retriever: str) -> float:
        return {"dense": self.weight_dense, "lexical": self.weight_lexical, "sparse": self.weight_sparse}.get(retriever, 1.0)
