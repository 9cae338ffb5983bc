"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from gridwise.llm import alignment, chat_format, decontaminate, importance, jaccard_join, license_scan, mixing, pii, quality_classifier, quality_rules, substring_dedup, token_output, url_filter

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_pii": pii.op4_pii,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op12_license_scan": license_scan.OP12_SQL,
    "op13_importance_resampling": importance.OP13_SQL,
}
