"""Queries of the training-data operators and their SQL oracles, where SQL can express them."""

from __future__ import annotations

from . import chat, exact_dedup, hard_negatives, licenses, line_dedup, mixing, near_vectors, ngram_join, packing, quality, repeats, secrets, turn_repair

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_suffix_dedup": repeats.op2_suffix_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_embedding_near_dedup": near_vectors.op6_embedding_near_dedup,
    "op7_chat_format": chat.op7_chat_format,
    "op8_ngram_jaccard": ngram_join.op8_ngram_jaccard,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_turn_repair": turn_repair.op13_turn_repair,
}
ORACLE = {k: v for m in (chat, exact_dedup, hard_negatives, licenses, line_dedup, mixing, near_vectors, ngram_join, packing, quality, repeats, secrets, turn_repair) for k, v in m.ORACLE.items()}
