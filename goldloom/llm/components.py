"""Connected components of links, by smallest labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every end of a link (a, b); comp is the smallest id that links reach.

    Each round takes the smallest label among neighbours and then the label of that label, and is written to the shared
    folder, where lineage ends. Labels only fall; the loop ends when none does.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels["id"] == near["a"]).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        jump = low.join(labels.select(F.col("id").alias("low"), F.col("comp").alias("next")), "low", "left")
        step = written(jump.select("id", "old", F.least("low", F.coalesce("next", "low")).alias("comp")), "labels")
        labels = step.select("id", "comp")
        if not step.filter("comp < old").head(1):
            return labels
