"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    chat_format,
    exact_dedup,
    html_text,
    line_dedup,
    packing,
    quality_rules,
    sentencepiece_sampling,
    sharding,
    simhash,
    token_file,
)

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_sentencepiece_sampling": sentencepiece_sampling.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_simhash": simhash.query,
    "op5_line_dedup": line_dedup.query,
    "op6_quality_rules": quality_rules.query,
    "op7_html_text": html_text.query,
    "op8_token_file": token_file.query,
    "op9_sharding": sharding.query,
    "op10_chat_format": chat_format.query,
}
ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op10_chat_format": chat_format.ORACLE_SQL,
}
