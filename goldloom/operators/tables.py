"""Tables between steps, and numbers for their rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine may lack the setting; it gets a temporary folder."""
    context = df.sparkSession.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='goldloom-')}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows with their place in order, from 1 on, without gaps.

    Rows are range-partitioned and sorted; a place is a row's place in its partition and the number of rows in those before,
    which is a list as long as there are partitions. So no task holds all rows, as a window over the whole table would.
    """
    at = "_at"
    while at in rows.columns:
        at = f"_{at}"
    placed = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(at), 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row per partition
    before, total = [], 0
    for r in counts:
        before.append((r["part"], total))
        total += r["count"]
    offsets = placed.sparkSession.createDataFrame(before, "_part long, _before long")
    number = F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), part == F.col("_part")).select(*rows.columns, number.alias(name))


class Conflict(ValueError):
    """Another writer was first."""


class Folder:
    """Small files in a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self.folder = spark, folder
        self.fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, below: str = "") -> list[str]:
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def get(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file that mustn't exist; it is there as a whole or not at all."""
        if self.fs.exists(self._at(name)):
            raise Conflict(f"{name} has been written by another run")
        out = self.fs.create(self._at(f"_{name}.tmp"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.fs.rename(self._at(f"_{name}.tmp"), self._at(name)):
            raise Conflict(f"{name} has been written by another run")
