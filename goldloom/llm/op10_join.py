"""Query op10: the whole documents table joined with itself by similarity of shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldloom.llm.common import arrow_batches, table
from goldloom.llm.ngram_join import jaccard_components


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")
