"""Durable runs: what a run has done is kept in files, so it can be resumed after a failure and looked up later.

A run's folder holds its states, state-<number>.json. A new state is written under another name and renamed, which makes it
visible as a whole or not at all; the one with the largest number holds. It lists the run's raw files, the runs that were done
when it began, and its steps with status, counts and the folder of the step's table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldloom.operators.store import BucketTable
from goldloom.operators.tables import Conflict, Folder

STEP = "step string, raw_file long, status string, records_in long, records_out long, error string, path string, attempts long, version long"
STATE = f"run string, number long, entity string, status string, raw_files array<long>, base array<string>, steps array<struct<{STEP.replace(' string', ':string').replace(' long', ':long')}>>"


@dataclass
class Log:
    """Steps with their state and row counts."""

    rows: list[dict] = field(default_factory=list)

    def run(self, step: str, rows_in: int | None, work) -> DataFrame:
        entry = {"step": step, "status": "STARTED", "records_in": rows_in, "records_out": None, "error": None}
        self.rows.append(entry)
        try:
            out = work()
            entry |= {"status": "SUCCESS", "records_out": out.count()}
            return out
        except Exception as e:
            entry |= {"status": "FAILED", "error": str(e)[:500]}
            raise

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, status string, records_in long, records_out long, error string")


def batch_status(log: Log) -> str:
    """Where a batch stands by its steps."""
    if any(r["status"] == "FAILED" for r in log.rows):
        return "FAILED"
    done = {r["step"] for r in log.rows if r["status"] == "SUCCESS"}
    return "STAGING_LOADED" if "STAGING" in done else "RAW_LOADED" if "RAW" in done else "PROCESSING" if log.rows else "NEW"


def states(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The last state of each run of an entity type: a row for each run, in the form STATE."""
    folder = f"{path}/{entity}/runs"
    if not Folder(spark, folder).names():
        return spark.createDataFrame([], STATE)
    every = spark.read.schema(STATE).json(f"{folder}/*/state-*.json")
    return every.groupBy("run").agg(F.max_by(F.struct("*"), "number").alias("s")).select("s.*")


def run_log(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The stored process log: a row for each step of each run."""
    rows = states(spark, path, entity).select("run", F.col("status").alias("run_status"), F.posexplode("steps").alias("place", "s"))
    return rows.select("run", "run_status", "place", "s.*")


class Run:
    """One run over raw files: begun anew, or taken up again where an earlier try with the same files ended."""

    def __init__(self, spark: SparkSession, path: str, entity: str, raw_files: list[int], log: Log | None = None) -> None:
        self.spark, self.path, self.entity, self.log = spark, path, entity, log or Log()
        self.name = f"files-{min(raw_files)}-{max(raw_files)}-{len(raw_files)}"
        known = {r["run"]: r.asDict(recursive=True) for r in states(spark, path, entity).collect()}  # a row for each run
        for other in known.values():
            shared = sorted({*other["raw_files"]} & {*raw_files})
            if shared and other["status"] == "DONE":
                raise ValueError(f"raw file {shared[0]} is loaded already")
            if shared and other["run"] != self.name:
                raise Conflict(f"raw file {shared[0]} is part of the unfinished run {other['run']}")
        done = sorted((r for r in known.values() if r["status"] == "DONE"), key=lambda r: len(r["base"]))
        self.state = known.get(self.name) or {"run": self.name, "number": 0, "entity": entity, "status": "OPEN", "raw_files": sorted(raw_files), "base": [r["run"] for r in done], "steps": []}
        if self.state["base"] != [r["run"] for r in done]:
            raise Conflict(f"{done[-1]['run']} was done after {self.name} began: remove the folder of {self.name} and begin anew")
        #: The states of earlier runs, the oldest first.
        self.base = done
        self.store = Folder(spark, f"{path}/{entity}/runs/{self.name}")
        self._commit("OPEN")

    def _commit(self, status: str) -> None:
        self.state |= {"number": self.state["number"] + 1, "status": status}
        self.store.put(f"state-{self.state['number']:06d}.json", json.dumps(self.state) + "\n")

    def _read(self, entry: dict) -> DataFrame:
        if entry.get("version") is None:
            return self.spark.read.parquet(entry["path"])
        return BucketTable(self.spark, entry["path"]).read(entry["version"])

    def step(self, name: str, rows_in: int | None, make, raw_file: int | None = None, folder: str | None = None, key: list[str] | None = None) -> DataFrame:
        """The table of a step: read if the step is done, else made, written and noted.

        What a failed or interrupted try left in the step's folder is overwritten. With a key, make gives rows that go into the
        step's stored table, of which the run notes the version; a load that is tried again changes nothing twice.
        """
        entry = next((s for s in self.state["steps"] if (s["step"], s["raw_file"]) == (name, raw_file)), None)
        if entry and entry["status"] == "SUCCESS":
            self.log.rows.append({k: entry[k] for k in ("step", "status", "records_in", "records_out", "error")})
            return self._read(entry)
        if not entry:
            own = f"store/{name.lower()}" if key else f"run/{self.name}/{name.lower()}"
            entry = {"step": name, "raw_file": raw_file, "path": folder or f"{self.path}/{self.entity}/{own}", "attempts": 0, "version": None}
            self.state["steps"].append(entry)
        entry |= {"status": "STARTED", "records_in": rows_in, "records_out": None, "error": None, "attempts": entry["attempts"] + 1}
        self._commit("OPEN")

        def work() -> DataFrame:
            if not key:
                make().write.mode("overwrite").parquet(entry["path"])
                return self.spark.read.parquet(entry["path"])
            table = BucketTable(self.spark, entry["path"])
            entry["version"] = table.upsert(make())["version"] if table.versions() else BucketTable.create(make(), entry["path"], key).state()["version"]
            return table.read(entry["version"])

        try:
            out = self.log.run(name, rows_in, work)
        except Exception:
            entry |= {k: self.log.rows[-1][k] for k in ("status", "error")}
            self._commit("FAILED")
            raise
        entry |= {"status": "SUCCESS", "records_out": self.log.rows[-1]["records_out"]}
        self._commit("OPEN")
        return out

    def finish(self) -> None:
        """Marks the run as done, unless another one was done meanwhile."""
        other = {r["run"] for r in states(self.spark, self.path, self.entity).filter("status = 'DONE'").select("run").collect()}
        if other != {*self.state["base"]}:
            raise Conflict(f"{sorted(other - {*self.state['base']})} done meanwhile")
        self._commit("DONE")

    def last(self, step: str) -> DataFrame | None:
        """A step's table as the latest earlier run left it."""
        return self._read(_entry(self.base[-1], step)) if self.base else None

    def all_of(self, step: str) -> DataFrame | None:
        """A step's tables of all earlier runs, as one."""
        return self.spark.read.parquet(*(_entry(r, step)["path"] for r in self.base)) if self.base else None


def _entry(state: dict, step: str) -> dict:
    return next(s for s in state["steps"] if s["step"] == step)
