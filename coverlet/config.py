"""Settings of the coverage engine. Values that results depend on are fixed values of the method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    books_dir: str = "books"
    syllabi_dir: str = "syllabi"
    output: str = "output/recommendations"
    #: Folder of the table that keeps vectors between runs; none is kept for the empty string.
    cache_dir: str = ""
    # Table-of-contents pages.
    toc_scan_pages: int = 60
    toc_least_score: float = 35.0
    toc_run_gap: int = 2
    toc_merge_gap: int = 6
    toc_least_entries: int = 3
    # Pages of a chunk, and pages looked at for headings and content.
    chunk_pages: int = 12
    heading_pages: int = 500
    locator_pages: int = 400
    locator_window: int = 3
    locator_words: int = 20
    locator_slack: float = 0.05
    # Passage windows in words.
    window_words: int = 350
    overlap_words: int = 50
    least_words: int = 40
    # Similarity range, weights, thresholds.
    similarity_floor: float = 0.45
    similarity_ceiling: float = 0.85
    weight_semantic: float = 0.55
    weight_keyword: float = 0.20
    weight_fuzzy: float = 0.15
    weight_metadata: float = 0.10
    found_percent: float = 70.0
    tentative_percent: float = 55.0
    books_a_topic: int = 3
    resolve_score: float = 70.0
    author_gate: float = 55.0
    title_weight: float = 0.65
    author_weight: float = 0.35
    out_of_unit: float = 0.90
    out_of_section: float = 0.94
    # Printed-page offsets.
    offset_from: int = -3
    offset_to: int = 45
    anchor_chars: int = 600
    anchor_score: float = 70.0
    drift_score: float = 85.0
    drift_pages: int = 3
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    #: Python-style rounding of scores (ties by the binary value) instead of Spark's half-up.
    parity_rounding: bool = False
    #: Rows of a catalog up to which it is held by each task; beyond it is compared block by block.
    catalog_rows: int = 50_000


DEFAULT = EngineConfig()
