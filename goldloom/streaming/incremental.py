"""Incremental loads: new files of a folder become micro-batches, and each of them a durable run. An extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldloom.plans import pipeline, runs


def follow(spark: SparkSession, path: str, schema: str, checkpoint: str, load: Callable[[DataFrame, int], None], file_format: str = "json") -> StreamingQuery:
    """Runs load(batch, batch_id) once for every batch of files that hasn't been seen, then stops. A batch may come twice
    after a failure, with the same number; loads that replace their scope are safe."""
    stream = spark.readStream.schema(schema).format(file_format).load(path)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_runs(columns: list[tuple[str, str]], code: str, entity: str, path: str, order_by: list[str], first: int = 1, import_ts: str | None = None) -> Callable[[DataFrame, int], None]:
    """A load for follow(): batch number n becomes raw file first + n of its own run below path.

    A batch that comes again goes on where its run ended, and one whose run is done is left alone.
    """

    def load(batch: DataFrame, number: int) -> None:
        spark, raw_file = batch.sparkSession, first + number
        done = runs.states(spark, path, entity).filter(F.array_contains("raw_files", raw_file) & (F.col("status") == "DONE"))
        if not done.head(1) and batch.head(1):
            source = pipeline.Source(batch, columns, code, number, raw_file, order_by, import_ts)
            pipeline.run_all(spark, [source], entity, path)

    return load
