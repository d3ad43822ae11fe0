"""Queries of the operators of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from tessera.llm import binary, bpe, media, mixing, neardup, pii, quality, suffixes, topk, toxicity


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1,
        "op2_binary": binary.op2,
        "op3_neardup": neardup.op3,
        "op4_pii": pii.op4,
        "op5_quality": quality.op5,
        "op6_topk": topk.op6,
        "op7_suffixes": suffixes.op7,
        "op8_bpe": bpe.op8,
        "op9_toxicity": toxicity.op9,
        "op10_matroska": media.op10,
    }


def oracles() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op6_topk": topk.ORACLE}
