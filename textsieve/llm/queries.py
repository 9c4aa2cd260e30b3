"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe, chat, decontam, line_dedup, minhash, pii, quality, sharding, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_line_dedup": line_dedup.query,
        "op3_sharding": sharding.query,
        "op4_chat_rotation": chat.query,
        "op5_quality": quality.query,
        "op6_pii": pii.query,
        "op7_decontamination": decontam.query,
        "op8_minhash": minhash.query,
        "op9_bpe": bpe.query,
        "op10_suffix_dedup": suffix_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.SQL,
        "op3_sharding": sharding.SQL,
        "op4_chat_rotation": chat.SQL,
        "op5_quality": quality.SQL,
    }
