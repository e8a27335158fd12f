"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, license_scan, mixing, packing, secret_scan, shingle_join, suffix_dedup, topk, toxicity, vector_neardup

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_mix_sources": mixing.query,
    "op3_shingle_join": shingle_join.query,
    "op4_secret_scan": secret_scan.query,
    "op5_exact_topk": topk.query,
    "op6_license_scan": license_scan.query,
    "op7_vector_neardup": vector_neardup.query,
    "op8_toxicity": toxicity.query,
    "op9_chat_format": chat.query,
    "op10_pack": packing.query,
}

ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op5_exact_topk": topk.ORACLE,
    "op7_vector_neardup": vector_neardup.ORACLE,
    "op9_chat_format": chat.ORACLE,
}
