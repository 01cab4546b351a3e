"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, lm, packing, pii, quality, secrets, simhash, suffixes, token_files, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.quality_rules,
    "op2_simhash_near_dedup": simhash.simhash_near_dedup,
    "op3_secret_scan": secrets.secret_scan,
    "op4_suffix_dedup": suffixes.suffix_dedup,
    "op5_token_ids": token_files.token_ids,
    "op6_url_filter": urls.url_filter,
    "op7_packing": packing.packing,
    "op8_surrogates": pii.surrogates,
    "op9_benchmark_decontamination": decontaminate.benchmark_decontamination,
    "op10_lm_scores": lm.lm_scores,
}
ORACLES: dict[str, str] = {"op1_quality_rules": quality.oracle(), "op6_url_filter": urls.ORACLE}
