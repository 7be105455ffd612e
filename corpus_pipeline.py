"""A training corpus from documents: toxic texts go, exact and near duplicates go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next stage's
docs. All stages but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldloom.llm.bpe import transcode
from goldloom.llm.common import arrow_batches, keep_rows, row_hash, table, unused, written
from goldloom.llm.exact_dedup import exact_duplicates, normal_text
from goldloom.llm.mixing import apply_mix
from goldloom.llm.ngram_join import jaccard_components
from goldloom.llm.toxicity import train, with_score

VOCABULARY = "byte_bpe_50k.json"
#: Scores from here on are toxic.
TOXIC_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the texts that the classifier, fitted on docs and labels, calls toxic.

    Null and empty texts have no words and stay, rows without a doc_id and repeated rows are scored like others, and an empty
    table stays empty.
    """
    arrow_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "score")
    return with_score(docs, model, "text", name).filter(F.col(name) < TOXIC_FROM).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the smallest doc_id, a null one being the largest; null and empty texts are equal.

    Of rows with one doc_id, or none, and equal texts one stays. An empty table stays empty.
    """
    found = written(exact_duplicates(docs).select(F.struct("doc_id", "text_sha256").alias("name"), "kept"), "exact")
    sha = F.sha2(normal_text(F.col("text")).cast("binary"), 256)
    return keep_rows(docs, F.struct("doc_id", sha.alias("text_sha256")), found)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity of 0.8), keeps the row with the smallest doc_id.

    Texts without words are near to nothing and stay. Rows that repeat a doc_id are rows of their own, unless their texts are
    the same, too: then one stays. An empty table stays empty.
    """
    arrow_batches(spark)
    found = written(jaccard_components(docs, n=5, num=80, den=100).select(F.struct("doc_id", "row_hash").alias("name"), "kept"), "near")
    return keep_rows(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text").cast("binary")).alias("row_hash")), found)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: rows as often as the mix takes them, in its order.

    Rows without words weigh nothing and come as often as their place in the order allows. Rows that repeat a doc_id, or have
    none, are taken each for itself; a null source is a source. An empty table stays empty.
    """
    return apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, as little-endian unsigned 32-bit integers, and whether decoding gives the text again.

    A null text counts as empty and has no ids. Repeated rows stay repeated, null keys stay; an empty table stays empty.
    """
    arrow_batches(spark)
    coded = transcode(docs, public_tokenizers.path(VOCABULARY), keep=("lang", "source"), decoded=False)
    return coded.select("doc_id", "lang", "source", F.expr("length(token_ids) div 4").alias("n_tokens"), "lossless", "token_ids")


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixing), ("BPE", encoding)]

#: The fit of a classifier isn't expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
