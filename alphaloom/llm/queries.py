"""Registry of the training-data queries: one opN_<name> for each operator."""

from __future__ import annotations

from alphaloom.llm import classifier, html, media, ngram_join, packing, pieces, pii, quality_rules, suffix_dedup, url_filters

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_html_extraction": html.op6_html_extraction,
    "op7_packing": packing.op7_packing,
    "op8_quality_classifier": classifier.op8_quality_classifier,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_pii": pii.op10_pii,
}

SQL: dict[str, str] = {
    "op2_url_filters": url_filters.OP2_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
}
