"""The corpus pipeline: each stage takes (spark, docs, sf_dir), and its result is written and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notequarry.llm import decontaminate, packing, pii, quality, simhash
from notequarry.llm.common import stored, table

STAGES = [
    ("quality_rules", quality.rejecting),
    ("simhash_near_dedup", simhash.first_of_each),
    ("benchmark_decontamination", decontaminate.without_leaks),
    ("surrogates", pii.replacing),
    ("packing", packing.packing_stage),
]

#: Fingerprints, edit distances and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
