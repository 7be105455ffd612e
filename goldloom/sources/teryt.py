"""Registers of places and streets."""

from __future__ import annotations

from pyspark.sql import SparkSession

from goldloom.operators.validation import Teryt, teryt_index


def find_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """A file of a folder by name without regard to case, on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = sorted(str(f.getPath().toString()) for f in fs.listStatus(path) if f.getPath().getName().lower() == name.lower())
    return found[0] if found else None


def load(spark: SparkSession, folder: str) -> Teryt | None:
    """The index, or None unless both files are there."""
    simc, ulic = find_file(spark, folder, "SIMC.csv"), find_file(spark, folder, "ULIC.csv")
    if not simc or not ulic:
        return None
    read = lambda p: spark.read.option("header", True).option("sep", ";").csv(p)
    return teryt_index(read(simc), read(ulic))
