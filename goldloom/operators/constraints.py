"""Constraints of the stored tables: named conditions, counted in one pass or enforced before a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """Rows that a constraint forbids."""


def _json(c: str) -> Column:
    return F.col(c).isNull() | F.try_parse_json(F.col(c)).isNotNull()


def _in_order(start: str, end: str) -> Column:
    return F.col(end).isNull() | F.col(start).isNull() | (F.col(end) >= F.col(start))


# What the columns of a table may hold.
BATCH_STATES = ("NEW", "PROCESSING", "RAW_LOADED", "STAGING_LOADED", "COMPLETED", "FAILED")
DECISIONS = ("AUTO_MERGE", "REVIEW", "CANDIDATE")
ENTITIES = ("PERSON", "PARTY")


def batch() -> dict[str, Column]:
    return {"batch_state": F.col("import_status").isin(*BATCH_STATES)}


def candidates() -> dict[str, Column]:
    """Scored pairs: left_id, right_id, score, decision and, as JSON text, strong_json and conflict_json."""
    return {
        "entity_type": F.col("entity_type").isin(*ENTITIES),
        "decision": F.col("decision").isin(*DECISIONS),
        "score": F.col("score").between(0, 1),
        "pair_order": F.col("left_id") < F.col("right_id"),
        "strong_json": _json("strong_json"),
        "conflict_json": _json("conflict_json"),
    }


def links() -> dict[str, Column]:
    return {"dates": _in_order("valid_from", "valid_to")}


def relationships() -> dict[str, Column]:
    return {"no_self": F.col("parent_id") != F.col("child_id"), "dates": _in_order("valid_from", "valid_to")}


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(constraint, rows): how many rows each constraint forbids; a condition that is null forbids nothing."""
    bad = rows.agg(*(F.count_if(~c).alias(n) for n, c in checks.items()))
    named = F.array(*(F.struct(F.lit(n).alias("constraint"), F.col(n).alias("rows")) for n in checks))
    return bad.select(F.inline(named))


def enforce(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows, if no constraint forbids any; else ConstraintError."""
    bad = {r["constraint"]: r["rows"] for r in violations(rows, checks).filter("rows > 0").collect()}
    if bad:
        raise ConstraintError(f"rows that constraints forbid: {bad}")
    return rows
