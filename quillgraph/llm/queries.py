"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import alignment, bpe_automaton, chat, decontamination, embedding_dedup, language_id, line_dedup, merkle, mixing, ngram_join, pii, quality, suffix_dedup


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.query,
        "op2_pii": pii.query,
        "op3_ngram_join": ngram_join.query,
        "op4_language_id": language_id.query,
        "op5_mixing": mixing.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_line_dedup": line_dedup.query,
        "op8_embedding_dedup": embedding_dedup.query,
        "op9_chat": chat.query,
        "op10_quality": quality.query,
        "op11_merkle": merkle.query,
        "op12_alignment": alignment.query,
        "op13_bpe": bpe_automaton.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.ORACLE_SQL,
        "op7_line_dedup": line_dedup.ORACLE_SQL,
        "op8_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op9_chat": chat.ORACLE_SQL,
        "op11_merkle": merkle.ORACLE_SQL,
    }
