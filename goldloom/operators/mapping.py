"""Mapping-driven projection of source records to canonical rows, and the preprocessed projection."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from goldloom.functions import address, dates, text
from goldloom.operators.tables import numbered
from goldloom.plans import rules as R

_PERSON_SLOT = re.compile(rf"^({'|'.join(R.PERSON_ROLES)})(\d+)_({'|'.join(R.PERSON_ROLE_FIELDS)})$")
_PARTY_SLOT = re.compile(rf"^WspolnikPodmiot(\d+)_({'|'.join(R.PARTY_ROLE_FIELDS)})$")
_COUNT = re.compile(rf"^Liczba({'|'.join(R.PERSON_ROLES)}|WspolnikPodmiot)$")


def find_column(schema: StructType, name: str) -> Column | None:
    """A column by trimmed name without regard to case: a flat one first, then a path of struct fields."""
    fold = lambda s: s.strip().casefold()
    flat = next((f.name for f in schema.fields if fold(f.name) == fold(name)), None)
    if flat is not None:
        return F.col(f"`{flat}`")
    at, out = schema, None
    for part in name.split("."):
        if not isinstance(at, StructType):
            return None
        hit = next((f for f in at.fields if fold(f.name) == fold(part)), None)
        if hit is None:
            return None
        out = F.col(f"`{hit.name}`") if out is None else out.getField(hit.name)
        at = hit.dataType
    return out if "." in name else None


def identifier_kind(column: str) -> str:
    """NIP, REGON, ... that a source column holds: the first of its spellings that is known, else its last part in upper case."""
    last = column.rpartition(".")[2]
    spellings = ["".join(ch for ch in name if ch.isascii() and ch.isalnum()).casefold() for name in (last, column)]
    return next((R.IDENTIFIER_KEYS[s] for s in spellings if s in R.IDENTIFIER_KEYS), last.strip().upper())


def _value(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def map_columns(source: DataFrame, mapping: Iterable[tuple[str, str]], entity: str) -> DataFrame:
    """source with the canonical columns of an entity, from (source column, canonical column) pairs in order.

    The first value that isn't empty wins. Identifier columns gather in the map column Identifiers_JSON (JSON text), later ones
    winning. Of a person's numbered slots one is taken: the first with PESEL and both names, else the first with anything.
    """
    targets: dict[str, list[Column]] = {c: [] for c in R.CANONICAL[entity]}
    identifiers: list[Column] = []
    slots: dict[tuple[str, str], dict[str, Column]] = {}
    for name, canonical in mapping:
        c = find_column(source.schema, name)
        if c is None or canonical not in targets:
            continue
        slot = _PERSON_SLOT.match(name.strip())
        if entity == "PERSON" and slot:
            slots.setdefault((slot[1], slot[2]), {})[canonical] = _value(c)
        elif canonical == "Identifiers_JSON":
            identifiers.append(F.create_map(F.lit(identifier_kind(name)), _value(c)))
        else:
            targets[canonical].append(_value(c))
    if slots:
        names = sorted({k for v in slots.values() for k in v})
        empty = F.lit(None).cast("string")
        rows = F.array(*(F.struct(*(v.get(k, empty).alias(k) for k in names)) for v in slots.values()))
        has = lambda x, k: x[k].isNotNull() if k in names else F.lit(False)
        full = F.filter(rows, lambda x: has(x, "PESEL") & has(x, "First_Name") & has(x, "Last_Name"))
        some = F.filter(rows, lambda x: reduce(lambda a, b: a | b, (x[k].isNotNull() for k in names)))
        chosen = F.coalesce(F.try_element_at(full, F.lit(1)), F.try_element_at(some, F.lit(1)))
        for k in names:
            targets[k].append(chosen[k])
    out = {c: F.coalesce(*v) if v else F.lit(None).cast("string") for c, v in targets.items()}
    if identifiers:
        given = F.map_filter(_later_wins(identifiers), lambda _, v: v.isNotNull())
        out["Identifiers_JSON"] = F.when(F.size(given) > 0, F.to_json(given))
    out["Raw_Record_JSON"] = F.to_json(F.struct("*"))
    return source.select("*", *(v.alias(f"canon_{c}") for c, v in out.items()))


def _later_wins(maps: list[Column]) -> Column:
    """One map of several, where a later value that isn't null replaces an earlier one."""
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)), maps)


def drift(source: DataFrame, mapping: Iterable[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Mapped columns that source lacks, and columns of source that no mapping names (slots and ids apart)."""
    mapped = [m for m, _ in mapping]
    missing = [m for m in mapped if find_column(source.schema, m) is None]
    known = {m.strip().casefold() for m in mapped} | {m.split(".")[0].strip().casefold() for m in mapped} | {c.casefold() for c in R.SOURCE_ID_COLUMNS}
    extra = [c for c in source.columns if c.strip().casefold() not in known and not (_PERSON_SLOT.match(c) or _PARTY_SLOT.match(c) or _COUNT.match(c))]
    return missing, extra


def key_drift(source: DataFrame, json_column: str, known: list[str]) -> DataFrame:
    """(key, rows) of JSON objects' keys that aren't known."""
    keys = F.map_keys(text.identifiers(F.col(json_column)))
    return source.select(F.explode(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>"))).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))


def source_record_id(source: DataFrame, canonical: Column | None, number: Column) -> Column:
    """Canonical id, then the known id columns in order, then the row's number."""
    options = ([_value(canonical)] if canonical is not None else []) + [_value(c) for c in (find_column(source.schema, n) for n in R.SOURCE_ID_COLUMNS) if c is not None]
    return F.coalesce(*options, number.cast("string"))


def related_persons(source: DataFrame) -> Column:
    """JSON array of the persons in numbered role slots, by role group and slot; null without any."""
    return _related(source, _PERSON_SLOT, lambda m: (R.PERSON_ROLES[m[1]], int(m[2]), m[3]), R.PERSON_ROLE_FIELDS, "role_group")


def related_parties(source: DataFrame) -> Column:
    return _related(source, _PARTY_SLOT, lambda m: ("PARTY_SHAREHOLDER", int(m[1]), m[2]), R.PARTY_ROLE_FIELDS, "relationship_group")


def _related(source: DataFrame, pattern: re.Pattern[str], read, fields: dict[str, str], group: str) -> Column:
    slots: dict[tuple[str, int], dict[str, Column]] = {}
    for c in source.columns:
        if m := pattern.match(c):
            g, slot, field = read(m)
            slots.setdefault((g, slot), {})[fields[field]] = _value(F.col(f"`{c}`"))
    if not slots:
        return F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    rows = [F.when(F.coalesce(*v.values()).isNotNull(), F.struct(F.lit(g).alias(group), F.lit(slot).alias("slot"), *(v.get(f, none).alias(f) for f in fields.values()))) for (g, slot), v in sorted(slots.items())]
    kept = F.array_compact(F.array(*rows))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def stage(mapped: DataFrame, entity: str, import_batch_id: int, raw_file_id: int, order_by: list[str]) -> DataFrame:
    """Typed staging rows of map_columns' output; Staging_ID is a row's place in order_by."""
    rows = numbered(mapped, order_by, "_row")
    c = lambda n: F.col(f"canon_{n}")
    date_columns = {n for n in R.CANONICAL[entity] if n.endswith("_Date")}
    typed = {n: text.sanitize(c(n)) for n in R.CANONICAL[entity]} | {n: dates.lenient_date(c(n)) for n in date_columns}
    if entity == "PERSON":
        typed["Sex"] = text.is_female(c("Sex"))
    else:
        typed |= {"Has_Virtual_Accounts": text.flag(c("Has_Virtual_Accounts")), "Bank_Accounts_JSON": F.to_json(text.json_list(c("Bank_Accounts_JSON"))), "Related_Persons_JSON": F.coalesce(c("Related_Persons_JSON"), related_persons(mapped)), "Related_Parties_JSON": F.coalesce(c("Related_Parties_JSON"), related_parties(mapped))}
    typed |= {"Source_Record_ID": source_record_id(mapped, c("Source_Record_ID"), F.col("_row")), "Raw_Record_JSON": c("Raw_Record_JSON")}
    return rows.select(F.col("_row").cast("long").alias("Staging_ID"), F.lit(import_batch_id).cast("long").alias("ImportBatch_ID"), F.lit(raw_file_id).cast("long").alias("RawFile_ID"), *(v.alias(n) for n, v in typed.items()))


def _parts(staged: DataFrame) -> dict[str, Column]:
    a = F.col("_address")
    t = text.text_key
    out = {"Street": t(a["street"]), "Building_Number": text.identifier(a["building"]), "Apartment_Number": text.identifier(a["apartment"]), "City": text.city(a["city"]), "Postal_City": text.city(a["postal_city"]), "Postal_Code": text.postal_code(a["postal_code"]), "District": t(F.col("District")), "Province": t(F.col("Province")), "Country": t(F.col("Country"))}
    out["Full_Address"] = address.full_address(out["Street"], out["Building_Number"], out["Apartment_Number"], out["Postal_Code"], out["City"], out["Country"])
    return {f"{k}_Normalized": v for k, v in out.items()}


def preprocess(staged: DataFrame, entity: str) -> DataFrame:
    """Normalised columns of staged rows, one row each; Preprocessed_ID is the Staging_ID."""
    c = F.col
    base = staged.withColumn("_address", address.split_address(c("Street"), c("Postal_City"), c("City"), c("Building_Number"), c("Apartment_Number"), c("Postal_Code")))
    keys, ids = text.text_key, text.identifier
    out: dict[str, Column] = {n: c(n) for n in ("Staging_ID", "ImportBatch_ID", "RawFile_ID")} | {"Preprocessed_ID": c("Staging_ID"), "Source_Record_ID": text.compact(c("Source_Record_ID"))} | _parts(staged)
    out |= {"Phone_Normalized": text.phone(c("Phone_Number")), "Email_Normalized": text.email(c("Email_Address"))}
    if entity == "PERSON":
        names = {n: keys(c(n)) for n in ("First_Name", "Second_Name", "Last_Name", "Family_Name", "Place_Of_Birth", "Citizenship")}
        out |= {f"{n}_Normalized": v for n, v in names.items()} | {f"{n}_Normalized": ids(c(n)) for n in ("PESEL", "Serial_Number_ID_Card", "Serial_Number_Passport")}
        out |= {"Full_Name_Normalized": text.full_name(names["First_Name"], names["Second_Name"], names["Last_Name"]), "Birth_Date": c("Birth_Date"), "Sex": c("Sex")}
    else:
        given = text.identifiers(c("Identifiers_JSON"))
        kind, number = text.registration_kind(c("Validation_Authority_ID")), ids(c("Validation_Authority_Entity_ID"))
        found = {k: ids(F.try_element_at(given, F.lit(k))) for k in ("NIP", "REGON", "KRS", "LEI")}
        for k in ("REGON", "KRS"):
            found[k] = F.coalesce(found[k], F.when(kind == k, number))
        out |= {f"{k}_Normalized": v for k, v in found.items()}
        short, form = F.coalesce(text.compact(c("Short_Name")), text.short_name(c("Name"))), F.coalesce(text.compact(c("Legal_Entity_Type")), text.legal_form(c("Name")))
        out |= {"Name_Normalized": keys(c("Name")), "Short_Name_Normalized": keys(short), "Legal_Entity_Type_Normalized": text.legal_entity_type(form)}
        out |= {f"{n}_Normalized": keys(c(n)) for n in ("Registration_Country", "Register_Status", "Business_Scope", "Ownership_Form", "Agent_Type", "Insurance_Company", "Registration_Status", "Validation_Sources", "Validation_Authority_ID", "Direct_Parent_Name", "Direct_Parent_Relationship_Type", "Direct_Parent_Relationship_Status", "Ultimate_Parent_Name", "Ultimate_Parent_Relationship_Type", "Ultimate_Parent_Relationship_Status")}
        out |= {f"{n}_Normalized": ids(c(n)) for n in ("Decision_Number", "Register_Number", "Managing_LOU", "Validation_Authority_Entity_ID", "Direct_Parent_LEI", "Ultimate_Parent_LEI")}
        out |= {f"{n.removesuffix('_JSON')}_Normalized_JSON": text.json_key(c(n)) for n in ("Bank_Accounts_JSON", "Related_Persons_JSON", "Related_Parties_JSON")}
        out |= {"Municipality_Normalized": text.city(c("Municipality")), "Website_Normalized": text.website(c("Website")), "Has_Virtual_Accounts": c("Has_Virtual_Accounts")}
        out |= {n: c(n) for n in R.PARTY_COLUMNS if n.endswith("_Date")}
    return base.select(*(v.alias(k) for k, v in out.items()))


def preprocessing_stamp() -> Column:
    """JSON note of the rules applied; its clock keeps it out of comparisons."""
    return F.to_json(F.struct(F.lit("trim_uppercase").alias("text"), F.lit("e164_when_possible").alias("phone"), F.lit("regex_split").alias("address"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at_utc")))
