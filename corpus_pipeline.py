"""A training corpus from raw documents: toxicity, exact dedup, near dedup, secrets, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import op3_secrets, op6_exact, op7_toxicity, op9_simhash, op10_packing
from pairwright.llm.common import shared_path, table

#: (name, function of spark, docs, sf_dir). Each works on all rows its predecessor kept.
STAGES = [
    ("toxicity", op7_toxicity.stage),
    ("exact dedup", op6_exact.stage),
    ("simhash near dedup", op9_simhash.stage),
    ("secret scan", op3_secrets.stage),
    ("packing", op10_packing.stage),
]

#: Two stages are learnt models, so SQL can't state the rows; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. Returns the pieces of packed sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
