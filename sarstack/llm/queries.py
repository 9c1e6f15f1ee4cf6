"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, line_dedup, mixing, near_dedup, quality_model, quality_rules, secret_scan, token_counts, token_files, url_filter

_OPS = {
    "op1_url_filter": (url_filter.op1_url_filter, url_filter.ORACLE_SQL),
    "op2_quality_model": (quality_model.op2_quality_model, quality_model.ORACLE_SQL),
    "op3_near_dedup": (near_dedup.op3_near_dedup, near_dedup.ORACLE_SQL),
    "op4_decontamination": (decontaminate.op4_decontamination, decontaminate.ORACLE_SQL),
    "op5_token_files": (token_files.op5_token_files, token_files.ORACLE_SQL),
    "op6_quality_rules": (quality_rules.op6_quality_rules, quality_rules.ORACLE_SQL),
    "op7_mixing": (mixing.op7_mixing, mixing.ORACLE_SQL),
    "op8_secrets": (secret_scan.op8_secrets, secret_scan.ORACLE_SQL),
    "op9_line_dedup": (line_dedup.op9_line_dedup, line_dedup.ORACLE_SQL),
    "op10_token_counts": (token_counts.op10_token_counts, token_counts.ORACLE_SQL),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _OPS.items() if sql}
