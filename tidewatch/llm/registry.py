"""Registered queries of the corpus operators."""

from __future__ import annotations

from . import chat, decontaminate, exact, mixing, phrases, secrets, simhash, suffix, tokens, toxicity


def queries():
    return {
        "op1_secret_scan": secrets.query,
        "op2_phrase_dedup": phrases.query,
        "op3_exact_dedup": exact.query,
        "op4_simhash_neardup": simhash.query,
        "op5_token_counts": tokens.query,
        "op6_chat_format": chat.query,
        "op7_source_mixing": mixing.query,
        "op8_suffix_dedup": suffix.query,
        "op9_toxicity": toxicity.query,
        "op10_decontamination": decontaminate.query,
    }


def oracle_sql():
    return {"op3_exact_dedup": exact.ORACLE, "op6_chat_format": chat.ORACLE, "op7_source_mixing": mixing.ORACLE}
