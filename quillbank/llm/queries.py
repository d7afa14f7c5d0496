"""Queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from quillbank.llm import bpe, ctw, decontam, langid, line_dedup, minmax_dedup, pfp_dedup, quality, toxicity, transcript

QUERIES = {
    "op1_minmax_dedup": minmax_dedup.op1,
    "op2_quality_rules": quality.op2,
    "op3_context_tree_score": ctw.op3,
    "op4_decontamination": decontam.op4,
    "op5_prefix_free_dedup": pfp_dedup.op5,
    "op6_chat_format": transcript.op6,
    "op7_toxicity": toxicity.op7,
    "op8_byte_bpe": bpe.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_language_id": langid.op10,
}

ORACLES = {
    "op1_minmax_dedup": minmax_dedup.ORACLE,
    "op2_quality_rules": quality.ORACLE,
    "op4_decontamination": decontam.ORACLE,
    "op5_prefix_free_dedup": pfp_dedup.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
