"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from tabsmith.llm import (byte_bpe, centroids, chat_format, fingerprints, line_dedup, lm_scoring, ngram_join, packing,
                          quality_classifier, quality_rules, simhash, source_divergence, token_files)


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_lm_scoring": lm_scoring.op4_lm_scoring,
        "op5_packing": packing.op5_packing,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_token_files": token_files.op7_token_files,
        "op8_byte_bpe": byte_bpe.op8_byte_bpe,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_fingerprints": fingerprints.op10_fingerprints,
        "op11_centroid_clustering": centroids.op11_centroid_clustering,
        "op12_simhash_dedup": simhash.op12_simhash_dedup,
        "op13_source_divergence": source_divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat_format.OP2_SQL,
        "op3_ngram_join": ngram_join.OP3_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op11_centroid_clustering": centroids.OP11_SQL,
        "op13_source_divergence": source_divergence.OP13_SQL,
    }
