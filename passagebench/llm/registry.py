"""The queries of this subpackage and the SQL that some of them are compared with."""

from __future__ import annotations

from . import bpe, chat, decontamination, fingerprints, line_dedup, ngram_join, quality, substring_dedup, toxicity, url_filter

QUERIES = {
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op6_url_filter": url_filter.op6_url_filter,
    "op9_toxicity": toxicity.op9_toxicity,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op8_bpe": bpe.op8_bpe,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
}
ORACLE_SQL = {
    "op5_chat_formatting": chat.OP5_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op7_ngram_jaccard_join": ngram_join.OP7_SQL,
    "op10_benchmark_decontamination": decontamination.OP10_SQL,
}
