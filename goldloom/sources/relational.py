"""Named extracts of a relational client system: stars of left joins over its tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]


def jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str], split: dict[str, tuple[str, int, int, int]] | None = None) -> Tables:
    """Tables by JDBC. split: table to (column, low, high, parts), for parallel reads."""

    def read(name: str) -> DataFrame:
        if split and name in split:
            column, low, high, parts = split[name]
            return spark.read.jdbc(url, name, column, low, high, parts, properties=properties)
        return spark.read.jdbc(url, name, properties=properties)

    return read


def _role(df: DataFrame, kind_column: str, kind: str, value: str, name: str, *more: str) -> DataFrame:
    keep = df
    for flag in more:
        keep = keep.filter(f"{flag} = 1")
    return keep.filter(F.col(kind_column) == kind).select("CUST_UID", F.col(value).alias(name))


def party_main(t: Tables) -> DataFrame:
    """One row per organisation and combination of confirmed contacts and active accounts, with its contract count."""
    ids, logs, places = t("CUSTOMER_IDENTIFIER"), t("CLIENT_CONTACT_LOG"), t("CUSTOMER_ADDRESS")
    deals = t("CONTRACT_PARTY").groupBy("CUST_UID").agg(F.count("*").alias("contract_count"), F.max("DEAL_ID").alias("last_deal_id"))
    out = t("CLIENT_ACCOUNT").filter("SUBJECT_KIND = 'ORG'")
    for side in (
        t("ORG_UNIT").select("ORG_UNIT_ID", "UNIT_LABEL"),
        _role(ids, "REF_KIND", "NIP", "REF_VALUE", "nip"),
        _role(ids, "REF_KIND", "REGON", "REF_VALUE", "regon"),
        _role(ids, "REF_KIND", "KRS", "REF_VALUE", "krs"),
        places.filter("LOC_ROLE = 'SEAT'").select("CUST_UID", "LINE_1", "LINE_2", "CITY_HINT", "POST_AREA", "ISO_MARKET"),
        _role(logs, "CHANNEL_CODE", "EMAIL", "CONTACT_PAYLOAD", "email", "IS_CONFIRMED"),
        _role(logs, "CHANNEL_CODE", "PHONE", "CONTACT_PAYLOAD", "phone", "IS_CONFIRMED"),
        t("PAYMENT_ACCOUNT").filter("IS_ACTIVE = 1").select("CUST_UID", F.col("CLEARING_REF").alias("account")),
        deals,
    ):
        out = out.join(side, "CUST_UID" if "CUST_UID" in side.columns else "ORG_UNIT_ID", "left")
    return out


def person_roles(t: Tables) -> DataFrame:
    return t("AGENT_ASSIGNMENT").select("ASSIGNMENT_ID", "CUST_UID", "GIVEN_TXT", "FAMILY_TXT", "NATIONAL_REF", "LICENSE_TOKEN", "ROLE_BUCKET", "VALID_SINCE", "VALID_UNTIL")


def related_parties(t: Tables) -> DataFrame:
    child = t("CLIENT_ACCOUNT").select(F.col("CUST_UID").alias("CHILD_UID"), F.col("PARTY_LABEL").alias("child_name"))
    return t("RELATED_CLIENT").join(child, "CHILD_UID").select("RELATION_ID", "PARENT_UID", "CHILD_UID", "child_name", "LINK_BUCKET", "VALID_SINCE", "VALID_UNTIL")


def person_main(t: Tables) -> DataFrame:
    """Agents and private clients in one list; a client's label is cut at its first space."""
    agents = t("AGENT_ASSIGNMENT").join(t("CLIENT_ACCOUNT").select("CUST_UID", "SUBJECT_KIND"), "CUST_UID").select(F.col("ASSIGNMENT_ID").cast("string").alias("record_id"), F.col("GIVEN_TXT").alias("first_name"), F.col("FAMILY_TXT").alias("last_name"), F.col("NATIONAL_REF").alias("pesel"), F.col("ROLE_BUCKET").alias("role"))
    label = F.trim("PARTY_LABEL")
    clients = t("CLIENT_ACCOUNT").filter("SUBJECT_KIND = 'PERSON'").select(F.col("CUST_UID").cast("string").alias("record_id"), F.when(F.instr(label, " ") > 0, F.substring_index(label, " ", 1)).otherwise(label).alias("first_name"), F.when(F.instr(label, " ") > 0, F.substring(label, F.instr(label, " ") + 1, F.length(label))).alias("last_name"))
    return agents.unionByName(clients, allowMissingColumns=True)


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """parents with a JSON array of their children's rows; children without a parent drop out."""
    rows = children.groupBy(F.col(child_key).alias(key)).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*children.columns)))).alias(name))
    return parents.join(rows, key, "left")


@dataclass(frozen=True)
class Extract:
    source: str
    name: str
    entity: str
    build: Callable[[Tables], DataFrame]


def _party_full(t: Tables) -> DataFrame:
    return with_children(with_children(party_main(t), person_roles(t), "CUST_UID", "CUST_UID", "Related_Persons_JSON"), related_parties(t), "CUST_UID", "PARENT_UID", "Related_Parties_JSON")


EXTRACTS = (Extract("INSURANCE_CORE", "party_main", "PARTY", _party_full), Extract("INSURANCE_CORE", "person_main", "PERSON", person_main))


def list_extracts() -> list[dict[str, str]]:
    return [{"source": e.source, "name": e.name, "entity": e.entity} for e in EXTRACTS]


def find_extract(source: str, name: str, entity: str) -> Extract:
    """An extract by name; "default" names an entity's only one."""
    for e in EXTRACTS:
        if (e.source, e.entity) == (source.strip().upper(), entity.strip().upper()) and name.strip().lower() in (e.name, "default"):
            return e
    raise ValueError(f"no extract {name!r} of {source!r} for {entity!r}")


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
