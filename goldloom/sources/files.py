"""Readers of register files and the raw landing area."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from goldloom.plans.rules import SOURCES

FILE_TYPES = ("csv", "json", "xml", "xlsx")


def file_type(name: str) -> str:
    kind = name.rpartition(".")[2].lower()
    if "." not in name or kind not in FILE_TYPES:
        raise ValueError(f"unsupported file type: {name!r}")
    return kind


def source_code(name: str) -> str:
    code = name.strip().upper()
    if code not in SOURCES:
        raise ValueError(f"unknown source system: {name!r}")
    return code


def _broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line has an odd number of quotes: then a quoted field goes over line feeds."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).filter(quotes % 2 == 1).head(1))


def read_csv(spark: SparkSession, path: str, sep: str = ",", multiline: bool | None = None) -> DataFrame:
    """All columns as text; a byte-order mark is dropped, quoted fields may hold line feeds.

    A file with such fields is read by one task, others are split; multiline says which, or is found out by one look at all lines.
    """
    whole = _broken_lines(spark, path) if multiline is None else multiline
    df = spark.read.option("header", True).option("multiLine", whole).option("escape", '"').option("sep", sep).csv(path)
    if not df.columns:
        raise ValueError("no header")
    return df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects or one object; nested objects stay structs."""
    return spark.read.option("multiLine", True).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    """Records as <field name="...">value</field> or as child elements; all values as text."""
    schema = "field array<struct<_name:string,_VALUE:string>>"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    pairs = raw.select(F.map_from_entries(F.transform("field", lambda f: F.struct(f["_name"], f["_VALUE"]))).alias("m")).filter("m is not null")
    names = [r["k"] for r in pairs.select(F.explode(F.map_keys("m")).alias("k")).distinct().orderBy("k").collect()]  # a schema's columns
    if names:
        return pairs.select(*(F.try_element_at("m", F.lit(n)).alias(n) for n in names))
    plain = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)
    if not plain.columns:
        raise ValueError(f"no <{row_tag}> element")
    return plain


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of each workbook, all values as text, read from wherever Spark reads.

    Blank rows are skipped, the first other row names the columns, blank names are dropped and short rows padded with null.
    """
    from goldloom.sources import xlsx

    books = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([[n for _, n in xlsx.header(book.as_py())]], pa.list_(pa.string()))], ["names"])

    names = [r["names"] for r in books.mapInArrow(heads, "names array<string>").distinct().collect()]  # a row per kind of header
    columns = list(dict.fromkeys(n for head in sorted(names) for n in head))
    if not columns:
        raise ValueError("no header")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book in batch.column(0):
                data = book.as_py()
                own = [n for _, n in xlsx.header(data)]
                for part in _chunks(xlsx.records(data)):
                    found = dict(zip(own, zip(*part)))
                    yield pa.RecordBatch.from_arrays([pa.array(found.get(c, [None] * len(part)), pa.string()) for c in columns], columns)

    return books.mapInArrow(rows, StructType([StructField(c, StringType()) for c in columns]))


def _chunks(rows: Iterator[tuple], size: int = 1000) -> Iterator[list[tuple]]:
    while part := list(islice(rows, size)):
        yield part


def read_any(spark: SparkSession, path: str) -> DataFrame:
    return {"csv": read_csv, "json": read_json, "xml": read_xml, "xlsx": read_xlsx}[file_type(path)](spark, path)


def count_records(spark: SparkSession, path: str) -> int:
    """Records of a file; an empty file is an error."""
    if spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] in (None, 0):
        raise ValueError("empty file")
    return read_any(spark, path).count()


def count_lines(spark: SparkSession, path: str) -> int:
    """Rows of a CSV file, its header included."""
    return spark.read.option("header", False).option("multiLine", _broken_lines(spark, path)).csv(path).count()


#: Up to so many different files their names are sent to all tasks.
MOST_NAMES = 100_000


def land(spark: SparkSession, path: str, source: str, landed: DataFrame | None = None) -> DataFrame:
    """(file_name, source_code, file_hash, file_size, content) of files whose bytes haven't landed before, from any source.

    Of files with the same bytes the one with the smallest name stays. Names and hashes are compared; contents stay where they are.
    """
    code = source_code(source)
    raw = spark.read.format("binaryFile").load(path).filter("length > 0")
    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit(code).alias("source_code"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"), "content")
    first = rows.groupBy("file_hash").agg(F.min("file_name").alias("file_name"))
    if landed is not None:
        first = first.join(landed.select("file_hash"), "file_hash", "left_anti")
    few = first.limit(MOST_NAMES + 1).count() <= MOST_NAMES
    return rows.join(F.broadcast(first) if few else first, ["file_hash", "file_name"]).select(*rows.columns)


def snapshot(rows: DataFrame) -> DataFrame:
    """Rows as JSON text, the form in which relational extracts land."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def land_snapshot(rows: DataFrame, folder: str, source: str, landed: DataFrame | None = None) -> DataFrame:
    """Writes rows as JSON lines into folder and lands the files: (file_name, source_code, file_hash, file_size, content)."""
    snapshot(rows).withColumnRenamed("record", "value").write.mode("overwrite").text(folder)
    return land(rows.sparkSession, f"{folder}/part-*", source, landed)


def append(rows: DataFrame, path: str, partition: list[str]) -> None:
    rows.write.mode("append").partitionBy(*partition).parquet(path)


def replace_scope(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Replaces exactly the partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def refuse_reload(existing: DataFrame, raw_file_id: int) -> None:
    if existing.filter(F.col("RawFile_ID") == raw_file_id).head(1):
        raise ValueError(f"raw file {raw_file_id} is loaded already")
