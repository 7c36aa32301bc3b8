"""The queries of this folder by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, link_graph, mixing, neardup, pii, quality_rules, rule_ensemble, substrings, token_counts, warc

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_rule_ensemble": rule_ensemble.op3_rule_ensemble,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_url_filters": link_graph.op5_url_filters,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_pii": pii.op8_pii,
    "op9_warc": warc.op9_warc,
    "op10_near_dedup": neardup.op10_near_dedup,
}
