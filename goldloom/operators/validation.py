"""Validation rules: each is a boolean column; all of an entity's rules become rows by one explode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldloom.functions import address, checks, text


@dataclass(frozen=True)
class Check:
    level: str
    code: str
    field: str
    value: Column
    valid: Column
    error: str
    when: Column | None = None


def results(rows: DataFrame, checks_: list[Check], keys: list[str]) -> DataFrame:
    """keys and a row per rule: level, rule_code, field_name, checked_value, status, severity and error."""
    made = []
    for k in checks_:
        ok = F.coalesce(k.valid, F.lit(False))
        row = F.struct(F.lit(k.level).alias("level"), F.lit(k.code).alias("rule_code"), F.lit(k.field).alias("field_name"), k.value.cast("string").alias("checked_value"), F.when(ok, "PASS").otherwise("ERROR").alias("status"), F.when(ok, "INFO").otherwise("ERROR").alias("severity"), F.when(ok, "OK").otherwise(k.error).alias("error"))
        made.append(row if k.when is None else F.when(k.when, row))
    return rows.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("r")).select(*keys, "r.*")


def staged_sex(raw_json: Column, staged: Column) -> Column:
    """Sex by the raw record's own field, where it has one that can be read, else the staged value."""
    fields = F.map_filter(text.identifiers(raw_json), lambda k, _: F.lower(F.trim(k)).isin("sex", "plec", "płeć", "gender"))
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.map_values(fields), lambda x: text.is_female(x)), lambda x: x.isNotNull()), F.lit(1)), staged)


def _addresses() -> list[Check]:
    if_known = F.col("city_known").isNotNull()
    return [
        Check("PREPROCESSING", "ADDR_TERYT_CITY_EXISTS", "City_Normalized", F.col("City_Normalized"), F.col("city_known"), "ERR_TERYT_CITY_NOT_FOUND", if_known),
        Check("PREPROCESSING", "ADDR_TERYT_STREET_EXISTS", "Street_Normalized", F.col("Street_Normalized"), F.col("city_known") & F.col("street_known"), "ERR_TERYT_STREET_NOT_FOUND", if_known),
    ]


def validate_persons(staged: DataFrame, done: DataFrame, today: Column | None = None, teryt: Teryt | None = None) -> DataFrame:
    today = F.current_date() if today is None else today
    own = staged.select("Staging_ID", F.col("Birth_Date").alias("s_birth"), staged_sex(F.col("Raw_Record_JSON"), F.col("Sex")).alias("s_sex"), F.col("Serial_Number_ID_Card").alias("s_card"))
    rows = with_teryt(done, teryt).join(own, "Staging_ID")
    c = F.col
    rules = [
        Check("PREPROCESSING", "PERSON_PESEL_CHECKSUM", "PESEL_Normalized", c("PESEL_Normalized"), checks.pesel(c("PESEL_Normalized")), "ERR_CHECKSUM_PESEL"),
        Check("STAGING", "PERSON_PESEL_BIRTH_DATE_MATCH", "Birth_Date", c("s_birth"), checks.pesel_birth_date_matches(c("PESEL_Normalized"), c("s_birth")), "ERR_PESEL_BIRTH_DATE_MISMATCH"),
        Check("STAGING", "PERSON_PESEL_SEX_MATCH", "Sex", c("s_sex"), checks.pesel_sex_matches(c("PESEL_Normalized"), c("s_sex")), "ERR_PESEL_SEX_MISMATCH"),
        Check("PREPROCESSING", "PERSON_PESEL_BIRTH_DATE_NOT_FUTURE", "PESEL_Normalized", c("PESEL_Normalized"), checks.not_later(checks.pesel_birth_date(c("PESEL_Normalized")), today), "ERR_PESEL_BIRTH_DATE_IN_FUTURE"),
        Check("STAGING", "PERSON_BIRTH_DATE_NOT_FUTURE", "Birth_Date", c("s_birth"), checks.not_later(c("s_birth"), today), "ERR_BIRTH_DATE_IN_FUTURE"),
        Check("PREPROCESSING", "PERSON_EMAIL_SYNTAX", "Email_Normalized", c("Email_Normalized"), checks.optional(c("Email_Normalized"), checks.email(c("Email_Normalized"))), "ERR_EMAIL_INVALID"),
        Check("STAGING", "PERSON_ID_CARD_CHECKSUM", "Serial_Number_ID_Card", c("s_card"), checks.optional(c("s_card"), checks.id_card(c("s_card"))), "ERR_CHECKSUM_ID_CARD"),
        *_addresses(),
        *(Check("PREPROCESSING", f"PERSON_{n.upper()}_STRING", n, c(n), checks.person_name(c(n)), f"ERR_{n.upper()}_TYPE", c(n).isNotNull()) for n in ("First_Name_Normalized", "Second_Name_Normalized", "Last_Name_Normalized", "Family_Name_Normalized")),
    ]
    return results(rows, rules, ["Preprocessed_ID", "RawFile_ID"])


def validate_parties(done: DataFrame, teryt: Teryt | None = None) -> DataFrame:
    c = F.col
    one = lambda code, field, check, error, may_lack=True: Check("PREPROCESSING", code, field, c(field), checks.optional(c(field), check(c(field))) if may_lack else check(c(field)), error)

    def span(code: str, start: str, end: str) -> Check:
        shown = F.when(c(start).isNotNull() | c(end).isNotNull(), F.concat(F.lit("start="), F.coalesce(c(start).cast("string"), F.lit("None")), F.lit("; end="), F.coalesce(c(end).cast("string"), F.lit("None"))))
        return Check("STAGING", code, f"{start},{end}", shown, checks.in_order(c(start), c(end)), f"ERR_{code.removeprefix('PARTY_')}")

    rules = [
        one("PARTY_NIP_CHECKSUM", "NIP_Normalized", checks.nip, "ERR_CHECKSUM_NIP"),
        one("PARTY_REGON_CHECKSUM", "REGON_Normalized", checks.regon, "ERR_CHECKSUM_REGON"),
        one("PARTY_KRS_FORMAT", "KRS_Normalized", checks.krs, "ERR_FORMAT_KRS"),
        one("PARTY_LEI_CHECKSUM", "LEI_Normalized", checks.lei, "ERR_CHECKSUM_LEI"),
        one("PARTY_EMAIL_SYNTAX", "Email_Normalized", checks.email, "ERR_EMAIL_INVALID"),
        one("PARTY_NAME_STRING", "Name_Normalized", checks.non_empty, "ERR_NAME_EMPTY", False),
        span("PARTY_ESTABLISHMENT_REGISTRATION_DATE_RANGE", "Establishment_Date", "Registration_Date"),
        span("PARTY_REGISTRATION_DATE_RANGE", "Registration_Date", "Deregistration_Date"),
        span("PARTY_RENEWAL_DATE_RANGE", "Last_Update_Date", "Next_Renewal_Date"),
        span("PARTY_DIRECT_PARENT_DATE_RANGE", "Direct_Parent_Relationship_Start_Date", "Direct_Parent_Relationship_End_Date"),
        span("PARTY_ULTIMATE_PARENT_DATE_RANGE", "Ultimate_Parent_Relationship_Start_Date", "Ultimate_Parent_Relationship_End_Date"),
        *_addresses(),
    ]
    return results(with_teryt(done, teryt), rules, ["Preprocessed_ID", "RawFile_ID"])


@dataclass(frozen=True)
class Teryt:
    """cities: (city, sym); streets: (sym, street), with every way of naming a street."""

    cities: DataFrame
    streets: DataFrame


def teryt_index(simc: DataFrame, ulic: DataFrame) -> Teryt:
    """Index of the registers of places (NAZWA, SYM) and streets (SYM, CECHA, NAZWA_1, NAZWA_2)."""
    key = text.text_key
    cities = simc.select(key(F.col("NAZWA")).alias("city"), F.col("SYM").alias("sym")).filter("city is not null").distinct()
    prefix, one, two = address.street_prefix(F.col("CECHA")), key(F.col("NAZWA_1")), key(F.col("NAZWA_2"))
    names = F.array_compact(F.array(F.concat_ws(" ", prefix, one), F.when(two.isNotNull(), F.concat_ws(" ", prefix, one, two))))
    streets = ulic.filter(prefix.isNotNull() & one.isNotNull()).select(F.col("SYM").alias("sym"), F.explode(names).alias("street")).distinct()
    return Teryt(cities, streets)


def street_variants(c: Column) -> Column:
    """array<string> of a normalised street's key, and the key with its last word first; empty without a prefix."""
    line = text.text_key(c)
    prefix, name = address.street_prefix(F.substring_index(line, " ", 1)), F.regexp_extract(line, r"^\S+ (.+)$", 1)
    words = F.split(name, " ")
    swapped = F.when(F.size(words) > 1, F.concat_ws(" ", prefix, F.element_at(words, -1), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")))
    return F.when(prefix.isNotNull() & (name != ""), F.array_compact(F.array(F.concat_ws(" ", prefix, name), swapped))).otherwise(F.array().cast("array<string>"))


def with_teryt(rows: DataFrame, teryt: Teryt | None) -> DataFrame:
    """rows with city_known and street_known; both null without registers. Blank values count as known.

    Distinct (city, street) values are looked up and joined back, so the registers meet each value once.
    """
    if teryt is None:
        return rows.withColumn("city_known", F.lit(None).cast("boolean")).withColumn("street_known", F.lit(None).cast("boolean"))
    wanted = rows.select("City_Normalized", "Street_Normalized").distinct().withColumn("q_city", text.text_key(F.col("City_Normalized")))
    cities = teryt.cities.select(F.col("city").alias("q_city")).distinct().withColumn("has_city", F.lit(True))
    asked = wanted.select("City_Normalized", "Street_Normalized", "q_city", F.explode(street_variants(F.col("Street_Normalized"))).alias("street"))
    in_city = asked.join(teryt.cities.withColumnRenamed("city", "q_city"), "q_city").join(teryt.streets, ["sym", "street"])
    anywhere = asked.filter("q_city is null").join(teryt.streets.select("street").distinct(), "street")
    found = in_city.select("City_Normalized", "Street_Normalized").unionByName(anywhere.select("City_Normalized", "Street_Normalized")).distinct().withColumn("has_street", F.lit(True))
    same = (F.col("w.City_Normalized").eqNullSafe(F.col("f.City_Normalized"))) & (F.col("w.Street_Normalized").eqNullSafe(F.col("f.Street_Normalized")))
    known = wanted.join(cities, "q_city", "left").alias("w").join(found.alias("f"), same, "left").select("w.City_Normalized", "w.Street_Normalized", (F.col("q_city").isNull() | F.coalesce("has_city", F.lit(False))).alias("city_known"), (text.is_blank(F.col("w.Street_Normalized")) | F.coalesce("has_street", F.lit(False))).alias("street_known"))
    back = (F.col("r.City_Normalized").eqNullSafe(F.col("k.City_Normalized"))) & (F.col("r.Street_Normalized").eqNullSafe(F.col("k.Street_Normalized")))
    return rows.alias("r").join(known.alias("k"), back, "left").select("r.*", "k.city_known", "k.street_known")


def with_domain_check(results_: DataFrame, domains: DataFrame) -> DataFrame:
    """Mail results where a domain that a lookup (domain, resolves) rejects turns PASS into ERROR. The lookup is made
    outside, once per distinct domain."""
    domain = F.when(F.col("rule_code").endswith("_EMAIL_SYNTAX"), F.lower(F.substring_index("checked_value", "@", -1)))
    joined = results_.withColumn("domain", domain).join(domains, "domain", "left")
    bad = F.coalesce((F.col("status") == "PASS") & ~F.col("resolves"), F.lit(False))
    return joined.withColumns({"status": F.when(bad, "ERROR").otherwise(F.col("status")), "severity": F.when(bad, "ERROR").otherwise(F.col("severity")), "error": F.when(bad, "ERR_EMAIL_INVALID").otherwise(F.col("error"))}).drop("domain", "resolves")
