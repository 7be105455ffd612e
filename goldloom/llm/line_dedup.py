"""Lines that many documents share, dropped everywhere but in one document; built from Spark functions alone.

Every line's key goes to 16 bytes of hash. (hash, document, position) rows are dealt into ranges of hash and document and sorted
within them by hash, document from the largest on, and position, so a frequent line spreads over as many ranges as it needs. A
range streams its rows into the first occurrence and the number of documents of each hash; what the ranges found is merged by
hash, a row for each hash and range. Rows of shared hashes other than the first document's make up the result: for each document
the runs of lines that stay, a bitmap in run lengths. Texts take no part until apply_bitmaps() cuts those that lose a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldloom.llm.common import SPACES, ascii_lower, discard, look_up, row_hash, split_by, written

#: Keys of so many code points count, and are dropped where so many documents hold them.
LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3


def lines_of(text: Column) -> Column:
    """Lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def shared_lines(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(hash, keeper, group_size) of hashes in enough documents; keeper is the largest doc_id, group_size the number of rows.

    lines: (hash, doc_id, pos). A null doc_id is the smallest, and rows without one are one document.
    """
    dealt = lines.select("hash", "doc_id", "pos").repartitionByRange("hash", F.desc("doc_id")).sortWithinPartitions("hash", F.desc("doc_id"), "pos")
    # Equal (hash, doc_id) never part, so a range counts its documents by itself, and the sums over ranges are exact.
    firsts = dealt.groupBy("hash", "doc_id").agg(F.count("*").alias("rows"))
    found = firsts.groupBy("hash").agg(F.max("doc_id").alias("keeper"), F.count("*").alias("documents"), F.sum("rows").alias("group_size"))
    return found.filter(F.col("documents") >= least_documents).select("hash", "keeper", "group_size")


def keep_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, row_hash, n_dropped, dropped) for each document that loses a line.

    dropped is a bitmap of lines in run lengths, an array of (first, last), both from 0 on. A document is named by its key and a
    hash of its text. Rows that repeat a key count as one document, and so do rows without a key, whose key is the smallest:
    among themselves none of them loses a line. Null and empty texts and empty tables give no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), row_hash(F.col(text)).alias("row_hash"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    keyed = rows.select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("line")).filter(F.length("line") >= least_length)
    lines = written(keyed.select("doc_id", "row_hash", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("hash")), "lines")
    shared = written(shared_lines(lines, least_documents), "shared")
    likely = split_by(lines, "hash", shared)[0]
    going = look_up(likely, shared, "hash").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # Repeated rows bring the same places.
    places = going.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    firsts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    lasts = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    runs = F.arrays_zip(firsts.alias("first"), lasts.alias("last"))
    out = written(places.select("doc_id", "row_hash", F.size("p").cast("long").alias("n_dropped"), runs.alias("dropped")), "bitmaps")
    discard(lines)
    discard(shared)
    return out


def _without_runs(lines: Column, dropped: Column) -> Column:
    """Lines before, between and after the runs of dropped, joined by line feeds."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(dropped, lambda r: r["first"]), F.array(F.size(lines)))
    pieces = F.transform(F.arrays_zip(starts.alias("from"), ends.alias("to")), lambda r: F.slice(lines, r["from"] + 1, r["to"] - r["from"]))
    return F.array_join(F.flatten(pieces), "\n")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row of docs; only texts that a bitmap may belong to are shuffled.

    Repeated rows give repeated rows, a null text one empty line, an empty table no rows; other columns are left out.
    """
    named = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), row_hash(F.col(text)).alias("row_hash"))
    named = named.withColumn("name", F.struct("doc_id", "row_hash"))
    marks = bitmaps.select(F.struct("doc_id", "row_hash").alias("name"), "n_dropped", "dropped")
    likely, clear = split_by(named, "name", marks)
    n_lines = F.size("lines").cast("long").alias("n_lines")
    whole = clear.select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))
    met = likely.join(marks, "name", "left").select("doc_id", "text", "n_dropped", "dropped", lines_of(F.col("text")).alias("lines"))
    stays = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_without_runs(F.col("lines"), F.col("dropped")))
    return whole.unionByName(met.select("doc_id", n_lines, F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), stays.alias("kept_text")))
