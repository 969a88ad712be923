"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import counting, decontaminate, jaccard, licences, mixing, negatives, pivots, quality, repeats, resampling, secrets, tokens, wrappers

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_license_scan": licences.op2_license_scan,
    "op3_token_output": tokens.op3_token_output,
    "op4_repeated_strings": repeats.op4_repeated_strings,
    "op5_html_extraction": wrappers.op5_html_extraction,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_token_counts": counting.op10_token_counts,
    "op11_embedding_neardup": pivots.op11_embedding_neardup,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op4_repeated_strings": repeats.SQL,
    "op6_secret_scan": secrets.SQL,
    "op9_jaccard_join": jaccard.SQL,
    "op11_embedding_neardup": pivots.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_hard_negatives": negatives.SQL,
}
