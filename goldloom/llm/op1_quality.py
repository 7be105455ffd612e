"""Query op1: quality rules over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldloom.llm.common import table
from goldloom.llm.quality import quality, sql


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


SQL = sql()
