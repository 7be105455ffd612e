"""Query op5: toxicity of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldloom.llm.common import arrow_batches, table
from goldloom.llm.toxicity import held_out, score, train


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
