"""From raw documents to packed training sequences, one written table after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import staged

#: (name, function of (spark, docs, sf_dir)); each works on all that its predecessor kept.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("language_id", stages.drop_unknown_language),
    ("exact_dedup", stages.drop_exact_copies),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("best_fit_packing", stages.pack_sequences),
]

#: The learned and hashed stages can't be told in SQL; a brute-force version tests the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
