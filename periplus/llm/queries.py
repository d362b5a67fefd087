"""Registry of the corpus queries, and their DuckDB oracles where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import ann_forest, bitpack_ids, license_scan, line_templates, mixing_pareto, packing_kk, quality_rules, simhash_trie, substring_dedup, suffix_dedup


def queries() -> dict[str, Callable]:
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_quality_rules": quality_rules.query,
        "op4_simhash": simhash_trie.query,
        "op5_ann_forest": ann_forest.query,
        "op6_packing": packing_kk.query,
        "op7_line_dedup": line_templates.query,
        "op8_mixing": mixing_pareto.query,
        "op9_token_files": bitpack_ids.query,
        "op10_license_scan": license_scan.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE,
        "op8_mixing": mixing_pareto.ORACLE,
        "op10_license_scan": license_scan.oracle(),
    }
