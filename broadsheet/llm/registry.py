"""Queries of the training-text operators and their SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, exact, extract, lines, media, near, packing, quality, secrets, toxicity


def queries() -> dict[str, Callable]:
    return {
        "op1_bpe": bpe.query,
        "op2_near": near.query,
        "op3_exact": exact.query,
        "op4_quality": quality.query,
        "op5_packing": packing.query,
        "op6_secrets": secrets.query,
        "op7_extract": extract.query,
        "op8_lines": lines.query,
        "op9_toxicity": toxicity.query,
        "op10_media": media.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near": near.ORACLE, "op3_exact": exact.ORACLE, "op8_lines": lines.ORACLE}
