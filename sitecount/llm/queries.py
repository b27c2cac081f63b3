"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from . import decontamination, minhash_dedup, mixing, pii, quality_classifier, quality_rules, secret_scan, substring_dedup, token_counts, tool_calls

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_quality_rules": quality_rules.query,
    "op3_secret_scan": secret_scan.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_mixing": mixing.query,
    "op6_pii": pii.query,
    "op7_minhash_dedup": minhash_dedup.query,
    "op8_token_counts": token_counts.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_tool_calls": tool_calls.query,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_secret_scan": secret_scan.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_minhash_dedup": minhash_dedup.ORACLE,
    "op8_token_counts": token_counts.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_tool_calls": tool_calls.ORACLE,
}
