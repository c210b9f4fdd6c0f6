"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_extract, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, sharding, substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_html_extraction": html_extract.op3_html_extraction,
        "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
        "op5_sharding": sharding.op5_sharding,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_mixing": mixing.op7_mixing,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_fingerprints": fingerprints.op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.OP1_SQL, "op2_substring_dedup": substring_dedup.OP2_SQL, "op4_minhash_near_dedup": near_dedup.OP4_SQL, "op5_sharding": sharding.OP5_SQL, "op7_mixing": mixing.OP7_SQL}
