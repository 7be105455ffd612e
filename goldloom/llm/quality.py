"""Quality rules: a table of thresholds compiled into one projection.

Measures are Spark expressions over the words and lines of a text; RULES bounds ratios of measures. The table is
compiled to a Column (and, for the check against another engine, to SQL text), so adding a rule adds a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldloom.llm.common import SEPARATOR, bind, words

WINDOW = 8
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = tuple(sorted(set(
    "the of and to in is that for it was on with as be by at this have from or an are not he she they we you but his her "
    "der die das und ist von mit zu den im ein eine nicht auf für des dem sich als auch es an werden aus er hat dass sie nach wird bei um am "
    "le la les de des et un une du en que qui dans pour pas sur au par plus ne se ce est il avec son sa ou mais nous vous elle "
    "el los las y que en un una por con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin".split()
)))


@dataclass(frozen=True)
class Rule:
    """low <= part / whole <= high; a whole of 0 passes."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("exclamations_per_word", "n_exclamations", "n_words", None, 0.5),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated_line_share", "n_dup_lines", "n_lines", None, 0.4),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def words_in_repeats(tokens: Column, n: int = WINDOW) -> Column:
    """Words that stand in n-word windows found twice or more, the first included.

    Windows are compared by 64-bit hashes; sorting (hash, position) brings equal windows together, and the union of the
    intervals [position, position + n) is counted. n log n steps for n words.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bind(pairs, lambda p: F.transform(F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"])), lambda x: x["i"]))
        return bind(F.array_sort(twice), lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - x, F.lit(n))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    some = lambda w: bind(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(tokens) > n, bind(tokens, some)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and all measures of the whole texts; null counts as a text without words."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), t.alias("t"), words(F.col(text)).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    count = lambda c, f: F.size(F.filter(c, f)).cast("long")
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        words_in_repeats(F.col("w")).alias("n_repeat_words"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclamations"),
        count(F.col("w"), lambda x: F.lower(x).isin(*STOP_WORDS)).alias("n_stop_words"),
        F.size("l").cast("long").alias("n_lines"),
        count(F.col("l"), lambda x: x.rlike(r"^[\x20\x09]*[-*+][\x20\x09]")).alias("n_bullet_lines"),
        count(F.col("l"), lambda x: x.endswith("...")).alias("n_ellipsis_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one expression."""
    out = F.lit(True)
    for r in rules:
        share = F.col(r.part) / F.nullif(F.col(r.whole), F.lit(0))
        if r.low is not None:
            out &= F.coalesce(share >= F.lit(r.low), F.lit(True))
        if r.high is not None:
            out &= F.coalesce(share <= F.lit(r.high), F.lit(True))
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, the measures, base_failed and kept.

    Null, empty and blank texts have no words and fail the base rule. Repeated rows are judged one by one, an empty table
    gives an empty result, other columns are left out.
    """
    out = measures(docs, text, key).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & passes(rules)).withColumnRenamed("doc_id", key)


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same over the table documents in DuckDB's dialect."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = [f"coalesce({r.part} / nullif({r.whole}, 0) {op} {bound}, true)" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '{SEPARATOR}'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), spots AS (
    SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS i,
           unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda k: md5(array_to_string(w[k:k + {WINDOW - 1}], ' ')))) AS gram
    FROM d WHERE len(w) > {WINDOW}
), marked AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM spots
), gaps AS (
    SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS g FROM marked WHERE c > 1
), repeats AS (
    SELECT rid, sum(g)::BIGINT AS n FROM gaps GROUP BY rid
), m AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           length(t) - length(replace(t, '!', '')) AS n_exclamations,
           len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
           len(l) AS n_lines,
           len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*+][\x20\x09]'))) AS n_bullet_lines,
           len(list_filter(l, lambda x: ends_with(x, '...'))) AS n_ellipsis_lines
    FROM d LEFT JOIN repeats USING (rid)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b
"""
