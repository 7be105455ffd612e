"""Golden dimensions: upsert by identity, addresses, validity-dated links, identities, lineage and changes.

All groups are loaded by one plan. Where groups share an identity they fall into one dimension, and the last group wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldloom.operators.cluster import connected_components
from goldloom.operators.survivorship import candidates_of, is_pass, survivors
from goldloom.operators.tables import kept, numbered
from goldloom.plans import rules as R


def pivot_survivors(chosen: DataFrame, fields: list[str]) -> DataFrame:
    """One row per group with a column for each field."""
    return chosen.groupBy("group_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))


def survivors_of(records: DataFrame, entity: str, fields: dict[str, tuple[str, ...]], statuses: DataFrame | None = None) -> DataFrame:
    """Long survivors (group_id, field, value, source, rule, ...) of all groups and fields."""
    return survivors(candidates_of(records, entity, fields, statuses), ["group_id", "field"])


def accept(groups: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups with all required fields, and rejects (group_id, missing_fields, status)."""
    lacking = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in required)))
    marked = groups.withColumn("missing_fields", lacking)
    return marked.filter(F.size("missing_fields") == 0).drop("missing_fields"), marked.filter(F.size("missing_fields") > 0).select("group_id", "missing_fields", F.lit("OPEN").alias("status"))


def match_dimension(groups: DataFrame, existing: DataFrame, identities: list[str], dim_id: str) -> DataFrame:
    """groups with dim_id: of the dimensions that share an identity the one with the smallest id, else a new id.

    groups: group_id and identity columns; existing: dim_id and the same columns. Groups that share an identity value get one
    dimension. New ids follow the largest one, in order of group_id.
    """
    long = lambda df, key: df.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(i).alias("value")) for i in identities))).alias("i")).select(key, "i.*").filter("coalesce(value, '') <> ''")
    mine = long(groups, "group_id")
    first = mine.groupBy("kind", "value").agg(F.min("group_id").alias("left_id"))
    same = mine.join(first, ["kind", "value"]).select("left_id", F.col("group_id").alias("right_id")).distinct()
    owner = connected_components(same, groups.select(F.col("group_id").alias("id"))).select(F.col("id").alias("group_id"), F.col("component").alias("owner"))
    hits = mine.join(long(existing, dim_id), ["kind", "value"]).join(owner, "group_id").groupBy("owner").agg(F.min(dim_id).alias("found"))
    top = existing.agg(F.coalesce(F.max(dim_id), F.lit(0)).alias("top")).first()["top"]
    new = numbered(owner.select("owner").distinct().join(hits, "owner", "left_anti"), ["owner"], "n").select("owner", (F.col("n") + F.lit(top)).cast("long").alias("fresh"))
    ids = owner.join(hits, "owner", "left").join(new, "owner", "left").select("group_id", F.coalesce("found", "fresh").cast("long").alias(dim_id), F.when(F.col("found").isNotNull(), "UPDATED").otherwise("CREATED").alias("action"))
    return groups.join(ids, "group_id")


def last_of(matched: DataFrame, dim_id: str, fields: list[str]) -> DataFrame:
    """The values of each dimension's last group."""
    last = Window.partitionBy(dim_id).orderBy(F.col("group_id").desc())
    return matched.withColumn("n", F.row_number().over(last)).filter("n = 1").select(dim_id, *fields)


def upsert(matched: DataFrame, existing: DataFrame, dim_id: str, fields: list[str]) -> DataFrame:
    """The new dimension: rows of existing that no group hits, and the last group's values (nulls included) for the others."""
    fresh = last_of(matched, dim_id, fields)
    return existing.select(dim_id, *fields).join(fresh.select(dim_id), dim_id, "left_anti").unionByName(fresh)


def address_dimension(wanted: DataFrame, existing: DataFrame, columns: list[str]) -> DataFrame:
    """wanted with address_id: an address is the same if all columns are, nulls included; new ids follow the largest."""
    distinct = wanted.select(*columns).distinct()
    on = [distinct[c].eqNullSafe(existing[c]) for c in columns]
    known = distinct.join(existing, on, "left").groupBy(*(distinct[c] for c in columns)).agg(F.min("address_id").alias("known"))
    known = kept(known, "addresses")
    top = existing.agg(F.coalesce(F.max("address_id"), F.lit(0)).alias("top")).first()["top"]
    new = numbered(known.filter("known is null").select(*columns), columns, "n").select(*columns, (F.col("n") + F.lit(top)).cast("long").alias("address_id"))
    keyed = known.filter("known is not null").select(*columns, F.col("known").cast("long").alias("address_id")).unionByName(new)
    return wanted.alias("w").join(keyed.alias("k"), [F.col(f"w.{c}").eqNullSafe(F.col(f"k.{c}")) for c in columns]).select("w.*", "k.address_id")


def link_addresses(links: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """Links with validity after a load.

    links: owner, address_id, valid_from, valid_to. wanted: owner, address_id, effective_from. An active link to the same address
    stays, and gets effective_from where it has no start; other active links of an owner in wanted are closed at effective_from,
    and a new one is opened.
    """
    w = wanted.select(owner, F.col("address_id").alias("w_address"), "effective_from")
    joined = links.join(w, owner, "left")
    close = F.col("valid_to").isNull() & F.col("w_address").isNotNull() & (F.col("address_id") != F.col("w_address"))
    same = F.col("valid_to").isNull() & F.coalesce(F.col("address_id") == F.col("w_address"), F.lit(False))
    start = F.coalesce("valid_from", F.when(same, F.col("effective_from")))
    known = joined.select(owner, "address_id", start.alias("valid_from"), F.when(close, F.col("effective_from")).otherwise(F.col("valid_to")).alias("valid_to"))
    active = links.filter("valid_to is null").select(owner, F.col("address_id").alias("w_address"))
    opened = w.join(active, [owner, "w_address"], "left_anti").select(owner, F.col("w_address").alias("address_id"), F.col("effective_from").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return known.unionByName(opened)


def effective_from(import_ts: Column) -> Column:
    return F.coalesce(F.to_date(import_ts), F.current_date())


def last_owners(wanted: DataFrame) -> DataFrame:
    """(identity_type, identity_value, party_id): the last writer (by seq) of each value."""
    last = F.max_by("party_id", "seq").alias("party_id")
    return wanted.filter("coalesce(identity_value, '') <> ''").groupBy("identity_type", "identity_value").agg(last)


def identity_bridge(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(identity_type, identity_value, party_id): one owner each; the last writer (by seq) takes a value over."""
    fresh = last_owners(wanted)
    rest = existing.select("identity_type", "identity_value", "party_id").join(fresh, ["identity_type", "identity_value"], "left_anti")
    return rest.unionByName(fresh.select(*rest.columns))


def quality_score(status: Column) -> Column:
    return F.when(is_pass(status), 1.0).when(status.isNull(), None).otherwise(0.0).cast("decimal(5,4)")


def trust_score(trust: Column) -> Column:
    """Trust as 0 to 1; a level of 0 to 100 is scaled."""
    return F.when(trust > 1, trust / 100).otherwise(trust).cast("decimal(5,4)")


def lineage(chosen: DataFrame, dims: DataFrame, dim_id: str) -> DataFrame:
    """(dim_id, attribute, value, source, rule, trust_score, quality_score) of the current values; the last group wins."""
    rows = chosen.join(dims.select("group_id", dim_id), "group_id")
    last = Window.partitionBy(dim_id, "field").orderBy(F.col("group_id").desc())
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select(dim_id, F.col("field").alias("attribute"), "value", "source", "rule", trust_score(F.col("trust")).alias("trust_score"), quality_score(F.col("status")).alias("quality_score"))


def leading_address(chosen: DataFrame) -> DataFrame:
    """Of each group's address fields the first present in the fixed order: group_id and the columns of survivors."""
    place = F.coalesce(*(F.when(F.col("field") == f, F.lit(k)) for k, f in enumerate(R.ADDRESS_LINK_FIELDS)))
    first = Window.partitionBy("group_id").orderBy("place")
    ranked = chosen.withColumn("place", place).filter("place is not null").withColumn("n", F.row_number().over(first))
    return ranked.filter("n = 1").drop("n", "place")


def address_link_lineage(chosen: DataFrame) -> DataFrame:
    """The leading address field of each group, its rule prefixed."""
    rule = F.concat(F.lit("ADDRESS_LINK_FROM_"), "rule").alias("rule")
    return leading_address(chosen).select("group_id", "field", "source", rule)


def changes(old: DataFrame, new: DataFrame, dim_id: str, fields: list[str]) -> DataFrame:
    """(dim_id, attribute, old_value, new_value) of dimensions in both; blanks equal nulls, values are compared as text."""
    plain = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    both = old.select(dim_id, *(plain(F.col(f)).alias(f"o_{f}") for f in fields)).join(new.select(dim_id, *(plain(F.col(f)).alias(f"n_{f}") for f in fields)), dim_id)
    rows = F.array(*(F.struct(F.lit(f).alias("attribute"), F.col(f"o_{f}").alias("old_value"), F.col(f"n_{f}").alias("new_value")) for f in fields))
    return both.select(dim_id, F.explode(rows).alias("c")).select(dim_id, "c.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def known_fields(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns that rows has."""
    return rows.select(*(c for c in allowed if c in rows.columns))


def seed_missing(existing: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """existing with the seeds whose key it lacks."""
    return existing.unionByName(seeds.join(existing.select(*key), key, "left_anti").select(*existing.columns))
