"""Query op6: the mix of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldloom.llm.common import table
from goldloom.llm.mixing import mix, sql


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = sql()
