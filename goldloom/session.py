"""Session with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app: str = "goldloom", **settings: str) -> SparkSession:
    """A session; settings are added to and override SETTINGS (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()
