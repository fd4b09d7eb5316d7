"""Queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from . import decontam, html_text, jaccard_join, mixing, pii, quality_model, quality_rules, suffix_array, suffix_tree, urls

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_mix": mixing.op2_mix,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_urls": urls.op4_urls,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_html_text": html_text.op6_html_text,
    "op7_pii": pii.op7_pii,
    "op8_quality_model": quality_model.op8_quality_model,
    "op9_suffix_array": suffix_array.op9_suffix_array,
    "op10_suffix_tree": suffix_tree.op10_suffix_tree,
}

ORACLE = {
    "op1_jaccard_join": jaccard_join.OP1_SQL,
    "op2_mix": mixing.OP2_SQL,
    "op4_urls": urls.OP4_SQL,
    "op5_decontaminate": decontam.OP5_SQL,
    "op9_suffix_array": suffix_array.OP9_SQL,
    "op10_suffix_tree": suffix_tree.OP10_SQL,
}
