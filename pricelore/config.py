"""Thresholds of the catalogue engine."""

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Results depend on exactly these.
    target_currency: str = "EUR"
    confidence_threshold: float = 0.75
    price_min: float = 0.01
    price_max: float = 1_000_000
    code_min_len: int = 6
    toc_pairs_min: int = 3
    toc_short_numbers_min: int = 6
    toc_score_min: int = 4
    toc_hard_rows_max: int = 1
    toc_hard_codes_max: int = 1
    top_k_min: int = 8
    top_k_max: int = 20
    legal_penalty: float = 0.4
    stopword_penalty: float = 0.2
    table_ratio_min: float = 0.2
    currency_count_min: int = 5
    currency_ratio_min: float = 0.6
    marker_score_min: int = 6
    marker_count_min: int = 2
    table_score_min: float = 6.0
    table_columns_min: int = 3
    code_price_score_min: int = 6
    price_count_min: int = 3
    rows_min: int = 5
    unique_ratio_min: float = 0.15
    key_rate_min: float = 0.5
    sample_cap: int = 200
    text_len_min: int = 80
    table_numeric_ratio_min: float = 0.2
    ocr_text_max: int = 40
    ocr_penalty: float = 0.15
    early_stop_pages: int = 8
    early_stop_score: float = 12.0
    early_stop_strong: int = 4
    retry_multiplier: float = 2.0
    words_top_m: int = 16
    table_likelihood_min: float = 6.0
    table_penalty: float = 8.0
    toc_page_penalty: float = 6.0
    toc_soft_penalty: float = 0.85
    cooccurrence_pages_min: int = 3
    ocr_pages_max: int = 30
    sweep_pages: int = 40
    sweep_step_min: int = 10
    sweep_expand: int = 2
    sweep_hit_score: float = 10.0
    stitch_codes_min: int = 3
    stitch_prices_min: int = 3
    stitch_tolerance: float = 3.0
    stitch_rows_max: int = 40
    excellent_key_rate: float = 0.8
    excellent_review_rate: float = 0.2
    score_unique: float = 0.6
    score_review: float = 0.5
    score_conflicts: float = 0.8
    early_discard_factor: float = 0.5
    eval_pages_weak: int = 4
    export_mode: str = "partial_ok"


CONFIG = EngineConfig()
