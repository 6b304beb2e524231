"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from tessera.llm import chat, langid, mixing, oracles, packing, quality, simhash, substring, topk, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op4_curriculum_mix": mixing.op4,
    "op10_chat_format": chat.op10,
    "op9_best_fit_packing": packing.op9,
    "op6_simhash_pigeonring": simhash.op6,
    "op5_substring_index": substring.op5,
    "op2_language_ecoc": langid.op2,
    "op7_counterfactual_toxicity": toxicity.op7,
    "op3_warc_dictionary": warc.op3,
    "op8_norm_sorted_top_k": topk.op8,
}

ORACLES = dict(oracles.ORACLES)
