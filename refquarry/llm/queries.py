"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from refquarry.llm import exact_dedup, language_id, license_scan, line_dedup, ngram_join, packing, quality, sentence_pieces, topk_search, toxicity

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality": quality.op2_quality,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_packing": packing.op5_packing,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sentence_pieces": sentence_pieces.op8_sentence_pieces,
    "op9_language_id": language_id.op9_language_id,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

#: the others cannot be said in SQL; tests hold them against brute force, a round trip or held-out labels
ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op4_topk_search": topk_search.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
}
