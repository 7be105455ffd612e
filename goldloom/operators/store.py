"""Tables that are changed by key without writing them anew: hash buckets, copied on write.

A table's folder holds data files, each of one bucket, and versions: lists of the files that make up the table, put in place by
a rename. A load looks for its keys in the files of their buckets, whose Parquet Bloom filters and key columns tell it which
files hold them. Only files with a changed row are written anew; new rows are files of their own until a bucket has MOST_FILES
of them. Files are never changed, so a reader keeps the version that it began with, and a load that is lost leaves no trace but
files that no version lists.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldloom.operators.tables import Folder, kept

#: Rows that a file is meant to hold, the most buckets, and how many files a bucket has before it is put together.
FILE_ROWS, MOST_BUCKETS, MOST_FILES = 8192, 1 << 16, 8


class BucketTable:
    """A table of rows with a key, which may have null parts. Rows that repeat a key are refused."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.folder = Folder(spark, f"{path}/versions")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], file_rows: int = FILE_ROWS, buckets: int | None = None) -> BucketTable:
        """The first version of a table: so many buckets that each holds about file_rows."""
        table = cls(rows.sparkSession, path)
        rows = kept(rows, "created")
        n = buckets or max(1, min(MOST_BUCKETS, -(-rows.count() // file_rows)))
        state = {"version": 0, "key": key, "buckets": n, "schema": rows.schema.json(), "files": []}
        table._commit(state, table._written(rows, state))
        return table

    def versions(self) -> list[int]:
        return [int(n[8:-5]) for n in self.folder.names() if n.startswith("version-")]

    def state(self, version: int | None = None) -> dict:
        """What a version, or the last one, is made of: its number, key, buckets, schema and files (bucket, path)."""
        at = max(self.versions()) if version is None else version
        return json.loads(self.folder.get(f"version-{at:06d}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.state(version))

    def _schema(self, state: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(state["schema"]))

    def _read(self, state: dict, files: list[dict] | None = None) -> DataFrame:
        chosen = state["files"] if files is None else files
        if not chosen:
            return self.spark.createDataFrame([], self._schema(state))
        return self.spark.read.schema(self._schema(state)).parquet(*(f"{self.path}/{f['path']}" for f in chosen))

    @staticmethod
    def _bucket(state: dict) -> Column:
        return F.pmod(F.xxhash64(*state["key"]), F.lit(state["buckets"])).cast("int")

    def _written(self, rows: DataFrame, state: dict) -> list[dict]:
        """Writes rows as one file for each bucket; the files."""
        name = f"data/{state['version'] + 1:06d}-{uuid.uuid4().hex}"
        columns = self._schema(state).fieldNames()
        placed = rows.select(*columns, self._bucket(state).alias("_bucket"))
        writer = placed.repartition("_bucket").sortWithinPartitions("_bucket", *state["key"]).write.partitionBy("_bucket")
        for k in state["key"]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.path}/{name}")
        made = Folder(self.spark, f"{self.path}/{name}")
        return [{"bucket": int(d[8:]), "path": f"{name}/{d}/{f}"} for d in made.names() if d.startswith("_bucket=") for f in made.names(d) if f.startswith("part-")]

    def _commit(self, state: dict, files: list[dict]) -> None:
        after = state | {"version": state["version"] + 1, "files": files}
        self.folder.put(f"version-{after['version']:06d}.json", json.dumps(after) + "\n")

    def upsert(self, rows: DataFrame, remove: DataFrame | None = None) -> dict[str, int]:
        """Puts rows in by key, and takes the keys in remove out; {version, files, rewritten, added, changed, new}.

        Rows that are as they were change nothing, and without a change there is no new version. A key in both stays.
        """
        state = self.state()
        key, columns = state["key"], self._schema(state).fieldNames()
        rest = [c for c in columns if c not in key]
        came = rows.select(*columns, F.lit(False).alias("_gone"))
        if remove is not None:
            lost = remove.select(*key).distinct().join(rows.select(*key), self._same(remove, rows, key), "left_anti")
            came = came.unionByName(lost.select(*key, F.lit(True).alias("_gone")), allowMissingColumns=True)
        came = kept(came.withColumn("_bucket", self._bucket(state)), "came")
        if came.groupBy(*key).count().filter("count > 1").head(1):
            raise ValueError(f"rows repeat a key of {key}")
        hit = {r["_bucket"] for r in came.select("_bucket").distinct().collect()}  # as many as there are buckets at most
        near = [f for f in state["files"] if f["bucket"] in hit]
        old = self._read(state, near).select(*key, F.struct(*rest, *key[:1]).alias("_old"), F.col("_metadata.file_path").alias("_file")) if near else None
        if old is None:
            found = came.withColumn("_file", F.lit(None).cast("string")).withColumn("_same", F.lit(False))
        else:
            both = came.alias("c").join(old.alias("o"), [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key], "left")
            same = reduce(lambda a, b: a & b, (F.col(f"c.{c}").eqNullSafe(F.col(f"o._old.{c}")) for c in rest), F.lit(True))
            found = both.select("c.*", "o._file", (F.col("_file").isNotNull() & ~F.col("_gone") & same).alias("_same"))
        work = kept(found.filter("not _same and not (_gone and _file is null)"), "work")
        counts = {r["_file"]: r["count"] for r in work.groupBy("_file").count().collect()}  # as many as there are files at most
        new = counts.pop(None, 0)
        if not counts and not new:
            return {"version": state["version"], "files": len(state["files"]), "rewritten": 0, "added": 0, "changed": 0, "new": 0}
        changed = [f for f in near if any(x.endswith(f["path"]) for x in counts)]
        filled = {r["_bucket"] for r in work.filter("_file is null").select("_bucket").distinct().collect()}
        full = {b for b in filled if sum(f["bucket"] == b for f in near) >= MOST_FILES}
        changed += [f for f in near if f["bucket"] in full and f not in changed]
        fresh = work.filter(~F.col("_gone")).select(*columns)
        if changed:
            before = self._read(state, changed)
            fresh = fresh.unionByName(before.join(work.select(*key), self._same(before, work, key), "left_anti").select(*columns))
        files = self._written(kept(fresh, "fresh"), state)
        gone = {f["path"] for f in changed}
        self._commit(state, [f for f in state["files"] if f["path"] not in gone] + files)
        return {"version": state["version"] + 1, "files": len(state["files"]) - len(gone) + len(files), "rewritten": len(gone), "added": len(files), "changed": sum(counts.values()), "new": new}

    @staticmethod
    def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
        return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in key))
