"""Registered queries of this folder and their DuckDB oracles."""

from __future__ import annotations

from . import bpe, chat, gam, langid, packing, quality_rules, sharding, simhash, topk, toxicity

QUERIES = {
    "op1_quality_gam": gam.op1_quality_gam,
    "op2_toxicity_crf": toxicity.op2_toxicity_crf,
    "op3_language_cnn": langid.op3_language_cnn,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_packing": packing.op5_packing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_bpe_automaton": bpe.op7_bpe_automaton,
    "op8_simhash_dedup": simhash.op8_simhash_dedup,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_sharding": sharding.op10_sharding,
}

ORACLES = {
    "op4_exact_top_k": topk.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
}
