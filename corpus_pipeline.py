"""A training-data pipeline over ``documents``: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontaminate, mixing, simhash, token_ids, toxicity

STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("near_duplicates", simhash.drop_near_copies),
    ("decontamination", decontaminate.drop_contaminated),
    ("mixing", mixing.mix_stage),
    ("token_ids", token_ids.token_stage),
]

#: Fingerprints by XXH64, the toxicity model and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.settle(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
