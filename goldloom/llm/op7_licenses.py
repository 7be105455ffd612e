"""Query op7: license scan of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldloom.llm.common import arrow_batches, table
from goldloom.llm.licenses import scan


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.transform("base", lambda b: b["label"])
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["start"])).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        "score",
    )
