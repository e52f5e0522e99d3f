"""Queries of this subpackage and, where SQL can say the same, their DuckDB statements."""

from __future__ import annotations

from . import bpe_codec, dart_minhash, decontaminate, image_copies, language_cnn, oracles, piece_codec, pii_semicrf, source_audit, substring_dedup, suffix_dedup, token_counts, token_links, toxicity

QUERIES = {
    "op1_pii_semicrf": pii_semicrf.op1_pii_semicrf,
    "op2_image_copies": image_copies.op2_image_copies,
    "op3_dart_minhash": dart_minhash.op3_dart_minhash,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_language_cnn": language_cnn.op5_language_cnn,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe_codec": bpe_codec.op10_bpe_codec,
    "op11_piece_codec": piece_codec.op11_piece_codec,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_token_links": token_links.op13_token_links,
}

ORACLES: dict[str, str] = {"op6_suffix_dedup": oracles.OP6, "op7_substring_dedup": oracles.OP7, "op12_source_audit": source_audit.ORACLE}
