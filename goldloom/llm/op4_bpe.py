"""Query op4: BPE encoding and decoding of the whole documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldloom.llm.bpe import transcode
from goldloom.llm.common import arrow_batches, table

VOCABULARY = "byte_bpe_50k.json"


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    coded = transcode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.expr("length(token_ids) div 4").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"),
    )
