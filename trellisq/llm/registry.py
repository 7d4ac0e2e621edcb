"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, lines, mixing, near_duplicates, personal, quality, secrets, sharding, substrings, suffixes

QUERIES = {f.__name__: f for f in (near_duplicates.op1_ngram_jaccard_join, quality.op2_quality_rules, substrings.op3_substring_dedup, decontaminate.op4_decontamination, secrets.op5_secret_scan, sharding.op6_sharding, personal.op7_pii, mixing.op8_mixing, suffixes.op9_suffix_dedup, lines.op10_line_dedup)}

ORACLE_SQL: dict[str, str] = {"op10_line_dedup": lines.OP10_SQL}
