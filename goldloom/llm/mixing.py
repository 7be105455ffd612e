"""Mixing sources to target weights by weighted fair queueing.

Every document, in a shuffled order of its source, finishes at a virtual time: the words of its source up to and with
it, divided by the source's target. Sources that need repeats start over, up to MOST times. All copies are sorted by
finish time and cut where their words reach the total budget.

Running sums are taken at two levels. A document's bucket comes from its place in the shuffled order; sums of buckets
are added up per source, and a window adds what stands before a document in its bucket, so that a source with a third
of all rows is spread over BUCKETS windows. The cut is found among sums of ranges of finish time and then inside the one
range that it falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldloom.llm.common import SEPARATOR, row_hash, unused, without, words, written

#: A document is taken so many times at most, and a target is at most so many times its source's size.
MOST = 3
#: Hexadecimal digits of the shuffled order that name a bucket.
BUCKET_DIGITS = 3
#: Ranges of finish time per unit; times from 4 on are one range.
RANGES = 4096


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """One small row per document: key, hash of the row, source, words and place in the shuffled order.

    The place is a hash of seed, key and text, so that rows that repeat a key, or have none, are shuffled like others.
    """
    whole = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), whole))
    return docs.select(F.col(key).alias("doc_id"), row_hash(F.col(source), F.col(text)).alias("row_hash"), F.coalesce(F.col(source), F.lit("")).alias("name"), F.col(source).isNull().alias("nameless"), F.size(words(F.col(text))).cast("long").alias("size"), order.alias("ord"))


def targets(buckets: DataFrame) -> DataFrame:
    """Per source: source_size, weight and target, with what exceeds MOST times a source's size shared anew by weight.

    buckets: (nameless, name, bucket, words). Sources in the order of MOST * size / weight: one is full if its share of
    what the full ones before it leave over exceeds its bound; those after it are then tested with the rest. This table has a
    row per source.
    """
    number = lambda c: c.cast("decimal(38,0)")
    s = buckets.groupBy("nameless", "name").agg(F.sum("words").alias("source_size"))
    s = s.withColumn("weight", (F.row_number().over(Window.orderBy("nameless", "name")) - 1) % 3 + 1)
    everything, by_bound = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("weight"), "nameless", "name")
    s = s.withColumns({"total": F.sum("source_size").over(everything), "before": F.coalesce(F.sum(MOST * F.col("source_size")).over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "open_weight": F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("full", number(MOST * F.col("source_size")) * F.col("open_weight") < number(F.col("weight")) * (F.col("total") - F.col("before")))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), MOST * F.col("source_size"))).over(everything), F.lit(0))
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    s = s.withColumn("target", F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise((F.col("weight") * rest).cast("double") / rest_weight.cast("double")))
    return s.select("nameless", "name", "source_size", "weight", "total", "target")


def finish_times(docs_sizes: DataFrame) -> DataFrame:
    """docs_sizes with source_size, target and done, the words of the source up to and with the document."""
    d = docs_sizes.withColumn("bucket", F.substring("ord", 1, BUCKET_DIGITS))
    sums = d.groupBy("nameless", "name", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("nameless", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = written(sums, "buckets")
    starts = sums.withColumn("start", before).drop("words").join(targets(sums), ["nameless", "name"])
    inside = Window.partitionBy("nameless", "name", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return d.join(starts, ["nameless", "name", "bucket"]).withColumn("done", F.col("start") + F.sum("size").over(inside))


def finish(copy: Column | int) -> Column:
    """Virtual finish time of the copy-th copy (from 0) of a document; null where the target is 0."""
    return (copy * F.col("source_size") + F.col("done")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))


def _place(time: Column) -> Column:
    return F.struct(time.alias("time"), F.col("nameless"), F.col("name"), F.col("ord"), F.col("doc_id"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, copies (0 to MOST), taken and first_time.

    Size is the number of words, null counts as 0. Sources in code point order, null last, weigh 1, 2, 3, repeating, and
    share the sum of all sizes. A source without words gets the target 0 and gives nothing; an empty table gives an empty
    result. Rows that repeat a key are documents of their own, and so are those without one. The order is a hash of seed, key and
    text, so reruns agree. row_hash tells rows with one key apart.
    """
    timed = written(finish_times(written(sizes(docs, text, key, source, seed), "sizes")), "timed")
    copies = timed.select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("copy")).withColumn("time", finish(F.col("copy"))).filter("time is not null")
    copies = copies.withColumn("range", F.least(F.floor(F.col("time") * RANGES), F.lit(4 * RANGES)))
    # At most 4 * RANGES + 1 sums.
    sums = copies.groupBy("range").agg(F.sum("size").alias("words"), F.first("total").alias("total"))
    upto = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    crossing = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("total")).orderBy("range").select("range", (F.col("upto") - F.col("words")).alias("before"), "total").first()
    taken = F.lit(MOST) * F.col("target").isNotNull().cast("int")
    if crossing:
        run = F.sum("size").over(Window.orderBy(_place(F.col("time"))).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(crossing["before"])
        last = copies.filter(F.col("range") == crossing["range"]).select(_place(F.col("time")).alias("place"), run.alias("run")).filter(F.col("run") <= crossing["total"]).agg(F.max("place").alias("place")).first()["place"]
        below = F.lit(crossing["range"] / RANGES)
        if last is None:
            fits = lambda c: finish(c) < below
        else:
            end = F.struct(*(F.lit(last[f]).alias(f) for f in ("time", "nameless", "name", "ord")), F.lit(last["doc_id"]).cast(timed.schema["doc_id"].dataType).alias("doc_id"))
            fits = lambda c: _place(finish(c)) <= end
        taken = sum((F.coalesce(fits(c), F.lit(False)) & finish(c).isNotNull()).cast("int") for c in map(F.lit, range(MOST)))
    out = timed.withColumn("copies", F.when(F.col("target") > 0, taken).otherwise(0))
    return out.select(F.col("doc_id").alias(key), F.when(~F.col("nameless"), F.col("name")).alias(source), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "done", "row_hash")


def apply_mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """The mix itself: rows of docs, each as often as taken, range-sorted by virtual finish time; columns as in docs.

    Rows that repeat a key, or have none, are taken each for itself: a row is known by its key, source and text, and rows that
    are equal in these are numbered. An empty table gives an empty result.
    """
    row, n, time = (unused(docs, c) for c in ("mix_row", "mix_n", "mix_time"))
    planned = mix(docs, text, key, source, seed).select(F.struct(F.col(key).alias("key"), "row_hash").alias(row), "source_size", "target", "done", "copies")
    planned = written(planned, "plan")
    marked = docs.withColumn(row, F.struct(F.col(key).alias("key"), row_hash(F.col(source), F.col(text)).alias("row_hash")))
    times = F.explode(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: finish(c))).alias(time)
    twice = written(planned.groupBy(row).count().filter("count > 1").select(row), "twice")
    if not twice.head(1):
        mixed = marked.join(planned.filter("copies > 0").select(row, times), row)
    else:
        numbered = lambda rows, order: rows.join(twice, row, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(row).orderBy(order)))
        single = without(marked, row, twice).join(without(planned, row, twice).filter("copies > 0").select(row, times), row)
        several = numbered(marked, F.lit(0)).join(numbered(planned, "done").filter("copies > 0").select(row, n, times), [row, n])
        mixed = single.unionByName(several.drop(n))
    return mixed.repartitionByRange(time, row).sortWithinPartitions(time, row).select(*docs.columns)


def sql(seed: int = 1) -> str:
    """The same over the table documents in DuckDB's dialect."""
    return rf"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS name, source IS NULL AS nameless, md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord,
           len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SEPARATOR}'), lambda x: x <> ''))::BIGINT AS size
    FROM documents
), s AS (
    SELECT nameless, name, sum(size)::HUGEINT AS source_size, (row_number() OVER (ORDER BY nameless, name) - 1) % 3 + 1 AS weight FROM d GROUP BY 1, 2
), b AS (
    SELECT *, sum(source_size) OVER () AS total,
           coalesce(sum({MOST} * source_size) OVER (ORDER BY source_size / weight, nameless, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(weight) OVER (ORDER BY source_size / weight, nameless, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
    FROM s
), f AS (SELECT *, {MOST} * source_size * open_weight < weight * (total - before) AS is_full FROM b),
t AS (
    SELECT nameless, name, source_size::BIGINT AS source_size, total,
           CASE WHEN is_full THEN ({MOST} * source_size)::DOUBLE
                ELSE (weight * (total - coalesce(sum(CASE WHEN is_full THEN {MOST} * source_size END) OVER (), 0)))::DOUBLE / (sum(CASE WHEN NOT is_full THEN weight END) OVER ())::DOUBLE END AS target
    FROM f
), timed AS (
    SELECT d.*, source_size, target, total, sum(size) OVER (PARTITION BY nameless, name ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS done
    FROM d JOIN t USING (nameless, name)
), copies AS (
    SELECT *, (copy * source_size + done)::DOUBLE / nullif(target, 0) AS time FROM timed, range({MOST}) r(copy)
), run AS (
    SELECT *, sum(size) OVER (ORDER BY time, nameless, name, ord, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM copies WHERE time IS NOT NULL
), counted AS (SELECT doc_id, count(*) AS copies FROM run WHERE upto <= total GROUP BY doc_id)
SELECT doc_id, size, source_size, target, size * coalesce(copies, 0) AS taken FROM timed LEFT JOIN counted USING (doc_id)
"""
