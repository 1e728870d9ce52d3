"""Queries of this subpackage and the SQL that states their results where SQL can."""

from __future__ import annotations

from . import decontam, licenses, lm, neardup, pieces, pii, quality, substrings, topk, toxicity

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_neardup": neardup.op2_neardup,
    "op3_pii": pii.op3_pii,
    "op4_licenses": licenses.op4_licenses,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_substrings": substrings.op7_substrings,
    "op8_decontam": decontam.op8_decontam,
    "op9_topk": topk.op9_topk,
    "op10_lm": lm.op10_lm,
}
ORACLE_SQL: dict[str, str] = {"op2_neardup": neardup.OP2_SQL, "op9_topk": topk.OP9_SQL}
