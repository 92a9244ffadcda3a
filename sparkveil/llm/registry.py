"""Queries and DuckDB SQL of this subpackage."""

from __future__ import annotations

from . import op1_binary, op2_toxicity, op3_jaccard, op4_secrets, op5_chat, op6_fingerprint, op7_packing, op8_mixing, op9_mixing_lm, op10_topk

QUERIES = {
    "op1_binary": op1_binary.op1_binary,
    "op2_toxicity": op2_toxicity.op2_toxicity,
    "op3_jaccard": op3_jaccard.op3_jaccard,
    "op4_secrets": op4_secrets.op4_secrets,
    "op5_chat": op5_chat.op5_chat,
    "op6_fingerprint": op6_fingerprint.op6_fingerprint,
    "op7_packing": op7_packing.op7_packing,
    "op8_mixing": op8_mixing.op8_mixing,
    "op9_mixing_lm": op9_mixing_lm.op9_mixing_lm,
    "op10_topk": op10_topk.op10_topk,
}

SQL = {"op3_jaccard": op3_jaccard.OP3_SQL, "op5_chat": op5_chat.OP5_SQL, "op10_topk": op10_topk.OP10_SQL}
