"""Settings of the engine, as one value that operators take apart."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults are fixed values of the knowledge-graph model."""

    chunk_words: int = 500
    overlap_words: int = 50
    small_doc_chars: int = 8000
    min_chunk_words: int = 50
    max_file_bytes: int = 50 * 1024 * 1024
    file_types: tuple[str, ...] = (".pdf", ".docx", ".doc")
    min_cluster_size: int = 3
    min_samples: int = 2
    merge_similarity: float = 0.72
    merge_similarity_small: float = 0.68
    small_project: int = 50
    min_confidence: float = 0.75
    missing_confidence: float = 0.7
    map_concepts: int = 20
    map_gaps: int = 3
    bridge_similarity: float = 0.60
    bridge_max_concepts: int = 500
    pair_low: float = 0.30
    pair_high: float = 0.85
    max_pairs: int = 500
    evidence_chunks: int = 3
    claims_per_concept: int = 4
    weak_coverage: float = 0.20
    weak_generality: float = 0.50
    weak_min_docs: int = 5
    gap_similarity: float = 0.55
    max_expected: int = 3
    max_bridging: int = 2
    top_concepts: int = 15
    top_domain: int = 5


DEFAULTS = Params()
