"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from codetally.llm import (
    decontaminate,
    hard_negatives,
    html_extraction,
    language_id,
    merkle,
    packing,
    piece_coding,
    pii,
    simhash,
    substring_dedup,
    token_counts,
    topk_search,
    url_filter,
)

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_pii": pii.op2_pii,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_topk_search": topk_search.op5_topk_search,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_language_id": language_id.op8_language_id,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_piece_coding": piece_coding.op11_piece_coding,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_url_filters": url_filter.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_topk_search": topk_search.ORACLE_SQL,
    "op7_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
