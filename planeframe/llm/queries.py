"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import caps, licenses, lm_scoring, main_text, ngram_join, packing, phrases, pieces, pii, prefix_trie, quality, tokens, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_personal_data": pii.op4_personal_data,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_embedding_dedup": caps.op8_embedding_dedup,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_main_text": main_text.op12_main_text,
    "op13_collocations": phrases.op13_collocations,
}

ORACLE_SQL = {
    "op2_quality_rules": quality.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op8_embedding_dedup": caps.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_collocations": phrases.ORACLE,
}
