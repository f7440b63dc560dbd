"""The corpus queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Modules of this folder that hold queries.
MODULES = ["op1_suffix_dedup", "op2_fingerprints", "op3_packing", "op4_secret_scans", "op5_substring_dedup", "op6_quality_rules", "op7_jaccard_join", "op8_mixing", "op9_license_scans", "op10_quality_classifier"]


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), "ORACLES", {})
    return found
