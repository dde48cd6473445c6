"""The queries and oracle SQL of this subpackage, for the registry."""

from __future__ import annotations

from engram.llm import chat_format, exact_dedup, fingerprints, language_id, lexical_search, lm_scoring, mixing, near_dedup, quality, sentence_pieces, simhash, token_counts, vector_codes

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_lm_scoring": lm_scoring.query,
    "op3_source_mixing": mixing.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_sentence_pieces": sentence_pieces.query,
    "op6_quality": quality.query,
    "op7_fingerprints": fingerprints.query,
    "op8_near_dedup": near_dedup.query,
    "op9_language_id": language_id.query,
    "op10_token_counts": token_counts.query,
    "op11_simhash_dedup": simhash.query,
    "op12_lexical_search": lexical_search.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op2_lm_scoring": lm_scoring.ORACLE_SQL,
    "op3_source_mixing": mixing.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_near_dedup": near_dedup.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
