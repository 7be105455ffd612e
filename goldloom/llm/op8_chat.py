"""Query op8: the whole conversations table formatted, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldloom.llm.chat import format_conversations, read_turns, unescape
from goldloom.llm.common import table

HARD = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return digests(format_conversations(turns.unionByName(hard)))


def digests(examples: DataFrame) -> DataFrame:
    """What the contract asks for, from the examples alone; only digests and trained texts meet in a conversation's group."""
    loss = unescape(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    turns = F.when(F.col("last"), read_turns(F.col("text")))
    read = examples.select("conv_id", "example", loss.alias("loss"), F.length("text").cast("long").alias("chars"), turns.alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    small = read.select("conv_id", "example", "loss", "chars", F.when(F.col("turns").isNotNull(), F.size("turns").cast("long")).alias("n"), F.sha2(whole.cast("binary"), 256).alias("sha"))
    by = small.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    text = F.array_join(F.col("losses.loss"), "")
    return by.select("conv_id", "n_turns", "turns_sha256", F.length(text).cast("long").alias("loss_chars"), F.sha2(text.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *, replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ': ', '\c') AS r,
           replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS t,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
           count(*) OVER (PARTITION BY conv_id) AS n
    FROM c
), f AS (
    SELECT *, sum(length('### ' || r || ': ' || t || '</turn>') + 1) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
