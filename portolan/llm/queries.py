"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .decontamination import op6_decontamination
from .language_model import op4_lm_scoring
from .licenses import op3_license_scan
from .personal_data import op8_personal_data
from .quality_rules import OP10_SQL, op10_quality_rules
from .sharding import op5_sharding
from .simhash import op1_simhash
from .substrings import OP7_SQL, op7_substring_dedup
from .token_counts import op9_token_counts

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE_SQL = {
    "op7_substring_dedup": OP7_SQL,
    "op10_quality_rules": OP10_SQL,
}
