"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import decontaminate, edits, hard_negatives, language, licenses, lines, near_duplicates, packing, pages, quality, resampling, suffix_tree, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op1_near_items": decontaminate.op1,
    "op2_licenses": licenses.op2,
    "op3_quality": quality.op3,
    "op4_language": language.op4,
    "op5_pages": pages.op5,
    "op6_lines": lines.op6,
    "op7_suffix_tree": suffix_tree.op7,
    "op8_token_counts": edits.op8,
    "op9_packing": packing.op9,
    "op10_near_duplicates": near_duplicates.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_toxicity": toxicity.op12,
    "op13_resampling": resampling.op13,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op1_near_items": decontaminate.ORACLE,
    "op6_lines": lines.ORACLE,
    "op10_near_duplicates": near_duplicates.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
