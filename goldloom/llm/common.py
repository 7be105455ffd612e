"""Helpers shared by the text operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed by the contracts: what separates words.
SEPARATOR = r"[\x20\x09-\x0D]+"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share.

    Where the setting is absent a temporary folder takes its place, on a single machine only.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='goldloom-')}")
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(folder: str) -> str | None:
    """The path of a folder that is mounted like a local one; None for stores that only Spark opens."""
    return folder.removeprefix("file://") if folder.startswith(("file:///", "/")) else None


#: Removes a query's shuffle files when it ends, instead of some time after the driver has collected its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost executor costs no recomputation.

    What the write has shuffled is removed when it ends, as only the table is read from then on.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 3_000_000


def arrow_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that a Python worker's memory stays bounded whatever the length of texts.

    All operators set the same bound, so it doesn't matter which of them a session ran last.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with a function that make() builds once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """Array of words of a text; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def ascii_lower(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, where a plain reuse would be inlined and computed for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Words of 64 bits of a filter over keys, and the least and the most of a filter that is sized by a count.
FILTER_WORDS = 1 << 18
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 20


def filter_words(keys: int) -> int:
    """Words for a filter over so many keys: 16 bits a key, up to MOST_WORDS; 0 where that leaves less than 4 bits a key.

    A filter of 0 words isn't worth its broadcast: it would let most rows pass.
    """
    words = max(LEAST_WORDS, 1 << max(0, keys // 4 - 1).bit_length())
    return words if words <= MOST_WORDS else MOST_WORDS if keys <= MOST_WORDS * 16 else 0


def _spot(column: str, words_of_filter: int) -> tuple[Column, Column]:
    """Word and bit of a value in a filter."""
    spot = F.pmod(F.xxhash64(column), F.lit(words_of_filter * 64))
    return F.floor(spot / 64), F.pmod(spot, F.lit(64)).cast("int")


def filter_over(keys: DataFrame, column: str, words_of_filter: int = FILTER_WORDS) -> DataFrame:
    """A filter of fixed size over a column: (word, bits), a row for each word in use."""
    word, bit = _spot(column, words_of_filter)
    spots = keys.select(word.alias("word"), bit.alias("bit")).distinct()
    return spots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _marked(rows: DataFrame, column: str, table_: DataFrame, words_of_filter: int, how: str) -> tuple[DataFrame, Column]:
    """rows joined with a filter, and whether a row's column may be among the filter's keys."""
    word, bit = _spot(column, words_of_filter)
    w, b, bits = (unused(rows, f"filter_{x}") for x in ("word", "bit", "bits"))
    marked = rows.withColumn(w, word).withColumn(b, bit).join(F.broadcast(table_.select(F.col("word").alias(w), F.col("bits").alias(bits))), w, how)
    return marked, F.coalesce(F.expr(f"(shiftright({bits}, {b}) & 1L) = 1L"), F.lit(False))


def passing(rows: DataFrame, column: str, table_: DataFrame, words_of_filter: int = FILTER_WORDS) -> DataFrame:
    """Rows whose column a filter doesn't clear."""
    marked, likely = _marked(rows, column, table_, words_of_filter, "inner")
    return marked.filter(likely).select(*rows.columns)


def unused(rows: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of rows has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def likely_in(rows: DataFrame, column: str, keys: DataFrame, words_of_filter: int = FILTER_WORDS) -> DataFrame:
    """Rows whose column is in keys (a column of the same name), with a few others: a filter of fixed size, broadcast.

    The filter has words_of_filter words of 64 bits; a row of 16 bytes travels for each word in use. It keeps rows that can't
    match out of a later shuffle, and where it is too small for the number of keys it only lets more rows pass.
    """
    return passing(rows, column, filter_over(keys, column, words_of_filter), words_of_filter)


def held_in(rows: DataFrame, column: str, keys: DataFrame, words_of_filter: int = FILTER_WORDS) -> DataFrame:
    """Rows whose column is in keys (a column of the same name, no value twice); most others aren't shuffled.

    The join is an inner one: the optimizer moves a semi join to the rows before the filter.
    """
    return likely_in(rows, column, keys, words_of_filter).join(keys.select(column), column).select(*rows.columns)


def without(rows: DataFrame, column: str, keys: DataFrame, words_of_filter: int = FILTER_WORDS) -> DataFrame:
    """Rows whose column isn't in keys (a column of the same name); only rows that the filter can't clear are shuffled.

    The join is an outer one: the optimizer moves an anti join to the rows before the filter.
    """
    marked, likely = _marked(rows, column, filter_over(keys, column, words_of_filter), words_of_filter, "left")
    clear, held = (marked.filter(c).select(*rows.columns) for c in (~likely, likely))
    found = unused(rows, "found")
    rest = held.join(keys.select(column).distinct().withColumn(found, F.lit(True)), column, "left").filter(F.col(found).isNull())
    return clear.unionByName(rest.select(*rows.columns))


def split_by(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose column may be among keys (a written table with a column of the same name), and rows whose column isn't.

    A filter that is sized by the number of keys tells them apart; with too many keys for one, all rows may be among them.
    """
    words_of_filter = filter_words(keys.count())
    if not words_of_filter:
        return rows, rows.limit(0)
    marked, likely = _marked(rows, column, written(filter_over(keys, column, words_of_filter), "filter"), words_of_filter, "left")
    return marked.filter(likely).select(*rows.columns), marked.filter(~likely).select(*rows.columns)


def row_hash(*columns: Column) -> Column:
    """With the key, the name of a row: rows that repeat a key and differ in these columns, nulls included, differ in it."""
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def keep_rows(docs: DataFrame, name: Column, found: DataFrame) -> DataFrame:
    """Rows of docs that found (name, kept) doesn't mark as left out, one of each name; name is made of docs' columns."""
    row = unused(docs, "row")
    kept = without(docs.withColumn(row, name), row, found.filter("not kept").select(F.col("name").alias(row)))
    twice = written(found.filter("kept").groupBy(F.col("name").alias(row)).count().filter("count > 1").select(row), "twice")
    if twice.head(1):
        kept = without(kept, row, twice).unionByName(kept.join(twice, row, "left_semi").dropDuplicates([row]).select(*kept.columns))
    return kept.select(*docs.columns)


def look_up(rows: DataFrame, level: DataFrame, key: str, hot_share: int = 10_000) -> DataFrame:
    """rows with the other columns of level, which has one row per key and group_size, its number of rows.

    Keys with more than one in hot_share rows, hot_share at most, are broadcast, so that no task gathers a frequent key; the
    others are joined by a shuffle.
    """
    total = level.agg(F.sum("group_size")).first()[0] or 0
    least = max(1000, total // hot_share)
    hot = F.broadcast(level.filter(F.col("group_size") > least))
    kept = level.columns
    found = rows.join(hot, key, "inner")
    rest = rows.join(hot.select(key), key, "left_anti").join(level.filter(F.col("group_size") <= least), key)
    return found.select(*rows.columns, *(c for c in kept if c != key)).unionByName(rest.select(*rows.columns, *(c for c in kept if c != key)))


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
