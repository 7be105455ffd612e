"""Which source's value of an attribute survives in a group, and by which rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldloom.plans import rules as R


def source_rank(entity: str, field: Column, source: Column) -> Column:
    """Place of a source in the order for a field; unknown sources come last."""
    rank = lambda order: F.coalesce(*(F.when(source == s, F.lit(k)) for k, s in enumerate(order)), F.lit(len(order)))
    orders: dict[tuple[str, ...], list[str]] = {}
    for f, o in R.ORDERS[entity].items():
        orders.setdefault(tuple(o), []).append(f)
    out = F.lit(None).cast("int")
    for order, fields in orders.items():
        out = F.when(field.isin(*fields), rank(order)).otherwise(out)
    return F.coalesce(out, rank(R.DEFAULT_ORDER[entity]))


def trust_level(source: Column) -> Column:
    """Trust of a source where its metadata has none."""
    return F.coalesce(*(F.when(source == s, F.lit(t)) for s, t in R.TRUST.items()))


def is_pass(status: Column) -> Column:
    return F.coalesce(F.upper(F.trim(status)) == "PASS", F.lit(False))


def survivors(candidates: DataFrame, group: list[str]) -> DataFrame:
    """One row per group: value, its source columns and rule.

    candidates: the columns in group, value (text), member_id, rank, trust, import_ts, status and, for addresses, confirmed.
    Blank values drop out. Then each level keeps the best: a passed validation, a confirmed address, the source's rank, trust,
    the newest import; the first level that leaves one value names the rule, and the smallest member_id decides after all.
    Two sorts of one partitioning: counts per level come from dense ranks over ever longer prefixes of the order.
    """
    confirmed = F.coalesce(F.col("confirmed"), F.lit(False)) if "confirmed" in candidates.columns else F.lit(False)
    rows = candidates.filter(F.coalesce(F.trim("value"), F.lit("")) != "").withColumns({"k1": (~is_pass(F.col("status"))).cast("int"), "k2": (~confirmed).cast("int"), "k3": F.col("rank").cast("int"), "k4": -F.coalesce(F.col("trust").cast("double"), F.lit(-1.0)), "k5": -F.coalesce(F.unix_micros(F.col("import_ts").cast("timestamp")), F.lit(-(1 << 62)))})
    keys = ["k1", "k2", "k3", "k4", "k5"]
    whole = Window.partitionBy(*group)
    counts = {"c0": F.count("*").over(whole)}
    # Rows on the best prefix of each length: dense_rank is 1 exactly there.
    for n in range(1, 6):
        counts[f"b{n}"] = F.dense_rank().over(whole.orderBy(*keys[:n]))
    rows = rows.withColumns(counts)
    rows = rows.withColumns({f"c{n}": F.sum((F.col(f"b{n}") == 1).cast("int")).over(whole) for n in range(1, 6)})
    rows = rows.withColumn("place", F.row_number().over(whole.orderBy(*keys, "member_id"))).filter("place = 1")
    labels = ["NON_EMPTY_VALUE", "PASSED_VALIDATION", "TERYT_CONFIRMED_ADDRESS", "SOURCE_PRIORITY", "TRUST_LEVEL", "NEWEST_IMPORT"]
    rule = F.coalesce(*(F.when(F.col(f"c{n}") == 1, F.lit(label)) for n, label in enumerate(labels)), F.lit("INPUT_ORDER_FALLBACK"))
    return rows.withColumn("rule", rule).drop(*keys, "place", *(f"c{n}" for n in range(6)), *(f"b{n}" for n in range(1, 6)))


def most_trusted(candidates: DataFrame, group: list[str]) -> DataFrame:
    """The value of the highest trust, the first on ties (by pos)."""
    return candidates.groupBy(*group).agg(F.max_by("value", F.struct(F.col("trust"), (-F.col("pos")).alias("p"))).alias("value"), F.max("trust").alias("trust"))


def candidates_of(records: DataFrame, entity: str, fields: dict[str, tuple[str, ...]], statuses: DataFrame | None = None) -> DataFrame:
    """Long table of values: group_id, field, value, member_id, source, rank, trust, import_ts, status.

    records: group_id, Preprocessed_ID, source_code, trust (0 to 1 or null), import_ts and the value columns. statuses:
    Preprocessed_ID, field_name, status of validation, where ERROR beats WARNING beats PASS over a field's columns.
    """
    blank_to_null = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(*([blank_to_null(c) for c in cs if c in records.columns] or [F.lit(None).cast("string")])).alias("value")) for f, cs in fields.items()))
    long = records.select("group_id", F.col("Preprocessed_ID").alias("member_id"), F.col("source_code").alias("source"), F.coalesce(F.col("trust"), trust_level(F.col("source_code")) / 100).alias("trust"), "import_ts", F.explode(values).alias("v")).select("*", "v.*").drop("v")
    long = long.withColumn("rank", source_rank(entity, F.col("field"), F.col("source")))
    if statuses is None:
        return long.withColumn("status", F.lit(None).cast("string"))
    columns = {c: f for f, cs in fields.items() for c in cs}
    known = statuses.filter(F.col("field_name").isin(*columns))
    by_field = F.coalesce(*(F.when(F.col("field_name") == c, F.lit(f)) for c, f in columns.items()))
    worst = field_status(known.withColumn("field", by_field), ["Preprocessed_ID", "field"]).withColumnRenamed("Preprocessed_ID", "member_id")
    return long.join(worst, ["member_id", "field"], "left")


def field_status(results: DataFrame, group: list[str]) -> DataFrame:
    """Worst status of a group's validation results."""
    grade = F.when(F.col("status") == "ERROR", 3).when(F.col("status") == "WARNING", 2).when(F.col("status") == "PASS", 1)
    worst = F.max(grade)
    return results.groupBy(*group).agg(F.when(worst == 3, "ERROR").when(worst == 2, "WARNING").when(worst == 1, "PASS").alias("status"))
