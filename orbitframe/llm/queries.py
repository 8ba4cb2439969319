"""Registered queries of the corpus operators."""

from __future__ import annotations

from orbitframe.llm import alignment, byte_repeats, collocations, decontamination, html_text, jaccard_join, oracles, packing, piece_tokens, quality_classifier, quality_rules, secret_scan, url_filter, word_repeats

QUERIES = {
    "op1_suffix_array_dedup": byte_repeats.op1_suffix_array_dedup,
    "op2_sentencepiece": piece_tokens.op2_sentencepiece,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_substring_dedup": word_repeats.op9_substring_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}
ORACLES: dict[str, str] = {
    "op4_secret_scan": oracles.SECRETS,
    "op6_ngram_jaccard_join": oracles.JACCARD,
    "op8_quality_rules": oracles.QUALITY,
    "op9_substring_dedup": oracles.SUBSTRINGS,
}
