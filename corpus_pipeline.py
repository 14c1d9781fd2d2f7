"""From raw documents to packed sequences: each stage's table is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph import scratch
from loomgraph.llm import packing, quality_classifier, quality_rules, simhash

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("quality_rules", quality_rules.stage),
    ("simhash", simhash.stage),
    ("packing", packing.stage),
]
#: Trained models and least-squares plans are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
