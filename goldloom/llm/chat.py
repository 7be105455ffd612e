r"""Chat formatting by prefix-target expansion.

A turn is written as "### role: text</turn>" and a line feed. Control strings inside roles and texts are escaped:
a backslash doubles, "###" becomes \h, "</turn>" becomes \e, and ": " becomes \c in a role. So an escaped text holds no
control string, and a formatted conversation splits back into its turns without loss.

Every assistant turn becomes an example of its own: all turns before it and its header are context, and only its text is
trainable. A conversation that doesn't end in an assistant turn gets one more example with nothing trainable, so that no
turn is lost. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit("\\c"))


def unescape(text: Column) -> Column:
    """Undoes escape and escape_role: between doubled backslashes, each code has one meaning."""
    plain = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\c"), F.lit(": "))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED) -> DataFrame:
    """One row per example: conv, example (from 0 on, in order of turns), last (whether the conversation ends with it), text,
    loss_start and loss_end.

    loss_start and loss_end are offsets in code points, the end exclusive; equal offsets mean that nothing is trainable.
    Turns are ordered by turn, then role and text, nulls first; null roles and texts count as empty. Rows with a null conv
    form one conversation. Repeated rows are turns of their own. An empty table gives an empty result. A row holds one example
    and the turns that it is made of, so it grows with the conversation, not with its square.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    head = lambda r: F.concat(F.lit("### "), escape_role(r["role"]), F.lit(": "))
    parts = whole.select("conv", F.transform("rows", lambda r: F.struct((r["role"] == trained).alias("trained"), head(r).alias("head"), escape(r["text"]).alias("body"))).alias("p"))
    size = F.size("p")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("p", i)["trained"] | (i == size))
    ending = parts.select("conv", "p", F.posexplode(ends).alias("example", "i"))
    one = lambda x: F.concat(x["head"], x["body"], F.lit(END))
    final = F.element_at("p", F.col("i"))
    made = ending.select("conv", "example", (F.col("i") == size).alias("last"), F.array_join(F.transform(F.slice("p", F.lit(1), F.col("i")), one), "").alias("text"), final["trained"].alias("trained"), F.length(final["body"]).alias("n"))
    start = F.length("text") - F.lit(len(END)) - F.col("n")
    return made.select(F.col("conv").alias(conv), "example", "last", "text", start.cast("long").alias("loss_start"), (start + F.when(F.col("trained"), F.col("n")).otherwise(0)).cast("long").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    cut = F.split(text, "</turn>\n")

    def turn(part: Column) -> Column:
        border = F.instr(part, ": ")
        return F.struct(unescape(F.substring(part, F.lit(5), border - 5)).alias("role"), unescape(F.substring(part, border + 2, F.length(part))).alias("text"))

    return F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), turn)
