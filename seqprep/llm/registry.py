"""Queries of this subpackage, by name, and their SQL for the reference engine where SQL can express them."""

from __future__ import annotations

from . import (
    op01_ngram_join,
    op02_language,
    op03_quality,
    op04_toxicity,
    op05_token_counts,
    op06_embedding_dedup,
    op07_nbest,
    op08_suffix_dedup,
    op09_packing,
    op10_extraction,
    op11_decontamination,
    op12_divergence,
    op13_prefix_trie,
)

QUERIES = {
    "op1_ngram_join": op01_ngram_join.query,
    "op2_language_id": op02_language.query,
    "op3_quality_rules": op03_quality.query,
    "op4_toxicity": op04_toxicity.query,
    "op5_token_counts": op05_token_counts.query,
    "op6_embedding_dedup": op06_embedding_dedup.query,
    "op7_nbest_segmentation": op07_nbest.query,
    "op8_suffix_dedup": op08_suffix_dedup.query,
    "op9_packing": op09_packing.query,
    "op10_html_extraction": op10_extraction.query,
    "op11_decontamination": op11_decontamination.query,
    "op12_source_divergence": op12_divergence.query,
    "op13_prefix_trie": op13_prefix_trie.query,
}

ORACLE = {
    "op1_ngram_join": op01_ngram_join.SQL,
    "op3_quality_rules": op03_quality.SQL,
    "op6_embedding_dedup": op06_embedding_dedup.SQL,
    "op8_suffix_dedup": op08_suffix_dedup.SQL,
    "op11_decontamination": op11_decontamination.SQL,
    "op12_source_divergence": op12_divergence.SQL,
    "op13_prefix_trie": op13_prefix_trie.SQL,
}
