"""The corpus pipeline: language identification, line dedup, near dedup, substring dedup, packing.

The stages stand in ``gyre.llm.pipeline``. Each takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gyre.llm.pipeline import PASSAGE, STAGES
from gyre.llm.session import shared_dir

__all__ = ["ORACLE_SQL", "PASSAGE", "STAGES", "run"]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
