"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidegraph.llm import chat, decontaminate, language_model, neighbours, packing, personal_data, quality, simhash, token_counts, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_simhash": simhash.op4_simhash,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_quality": quality.op6_quality,
    "op7_language_model": language_model.op7_language_model,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_chat": chat.op10_chat,
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op8_neighbours": neighbours.ORACLE,
    "op10_chat": chat.ORACLE,
}
