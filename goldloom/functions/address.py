"""Street lines and address lines.

A line has one of a few shapes; each shape is a pattern and says which part is street, city and postal code. A line is parsed
into a struct first, and the struct is merged into the record's parts afterwards, so the three lines of a record are three
expressions and not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldloom.functions.text import bind, city, compact

# The shapes of lines.
PREFIX = r"(?iu)^(ul\.?|ulica|al\.?|aleja|os\.?|osiedle|pl\.?|plac)\s+"
CANONICAL_PREFIXES = {"ul": "UL", "ulica": "UL", "al": "AL", "aleja": "AL", "os": "OS", "osiedle": "OS", "pl": "PL", "plac": "PL"}
APARTMENT = r"(?iu)\s+(?:m\.?|lok\.?|lokal)\s+"
BUILDING = r"\d+[A-Za-z]?(?:[-/]\d+[A-Za-z]?)?"
BUILDING_ONLY = rf"^\s*({BUILDING})\s*$"
STREET_BUILDING = rf"^\s*(.+?)\s+({BUILDING})\s*$"
STREET_POSTAL_CITY = r"^\s*(.+?),\s*(\d{2}-\d{3})\s+(.+?)\s*$"
POSTAL_CITY_STREET = r"^\s*(\d{2}-\d{3})\s+([^,]+?),\s*(.+?)\s*$"
STREET_CITY = r"^\s*(.+?),\s*([^,]+?)\s*$"
CITY_STREET = r"^\s*([^,]+?),\s*(.+?)\s*$"
POSTAL_CITY = r"^\s*(\d{2}-\d{3})\s+(.+?)\s*$"


def street_prefix(c: Column) -> Column:
    """UL, AL, OS or PL for a way of writing it, else null."""
    word = F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")
    return F.coalesce(*(F.when(word == k, F.lit(v)) for k, v in CANONICAL_PREFIXES.items()))


def street_line(c: Column) -> Column:
    """A street with its prefix in one form and flats after a slash; UL where no prefix is said and it isn't a bare number."""

    def finish(x: Column) -> Column:
        bare = x["rest"].rlike(r"(?i)^(UL|AL|OS|PL)\b") | x["rest"].rlike(BUILDING_ONLY) | (x["rest"] == "")
        return F.when(x["prefix"].isNotNull(), F.trim(F.concat_ws(" ", x["prefix"], x["rest"]))).when(bare, x["rest"]).otherwise(F.concat(F.lit("UL "), x["rest"]))

    rest = lambda t: F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, PREFIX, "")), APARTMENT, "/"))
    return bind(F.trim(c), lambda t: bind(F.struct(bind(F.regexp_extract(t, PREFIX, 1), street_prefix).alias("prefix"), rest(t).alias("rest")), finish))


def has_building(c: Column) -> Column:
    return F.coalesce(street_line(c).rlike(STREET_BUILDING), F.lit(False))


def is_building(c: Column) -> Column:
    return F.coalesce(street_line(c).rlike(BUILDING_ONLY), F.lit(False))


def _building(c: Column) -> tuple[Column, Column]:
    cut = F.split(c, "/", 2)
    return F.nullif(F.trim(F.get(cut, F.lit(0))), F.lit("")), F.nullif(F.trim(F.get(cut, F.lit(1))), F.lit(""))


def parse_street(c: Column) -> Column:
    """struct<street, building, apartment> of a street line."""

    def cut(line: Column) -> Column:
        only, both = line.rlike(BUILDING_ONLY), line.rlike(STREET_BUILDING)
        number = F.when(only, F.regexp_extract(line, BUILDING_ONLY, 1)).when(both, F.regexp_extract(line, STREET_BUILDING, 2))
        building, apartment = _building(number)
        street = F.when(only, None).when(both, F.trim(F.regexp_extract(line, STREET_BUILDING, 1))).otherwise(F.nullif(line, F.lit("")))
        return F.struct(street.alias("street"), building.alias("building"), apartment.alias("apartment"))

    return bind(street_line(c), cut)


def parse_line(c: Column) -> Column:
    """struct<street_part, postal_code, town> of an address line in one of the five shapes, null for any other line."""
    none = F.lit(None).cast("string")

    def shape(x: Column) -> Column:
        part = lambda p, k: F.regexp_extract(x, p, k)
        found = lambda street, code, town: F.struct(street.alias("street_part"), code.alias("postal_code"), town.alias("town"))
        street_first = part(STREET_CITY, 1)
        return (
            F.when(x.rlike(STREET_POSTAL_CITY), found(part(STREET_POSTAL_CITY, 1), part(STREET_POSTAL_CITY, 2), part(STREET_POSTAL_CITY, 3)))
            .when(x.rlike(POSTAL_CITY_STREET), found(part(POSTAL_CITY_STREET, 3), part(POSTAL_CITY_STREET, 1), part(POSTAL_CITY_STREET, 2)))
            .when(x.rlike(STREET_CITY) & (has_building(street_first) | is_building(street_first)), found(street_first, none, part(STREET_CITY, 2)))
            .when(x.rlike(CITY_STREET) & has_building(part(CITY_STREET, 2)), found(part(CITY_STREET, 2), none, part(CITY_STREET, 1)))
            .when(x.rlike(POSTAL_CITY), found(none, part(POSTAL_CITY, 1), part(POSTAL_CITY, 2)))
        )

    return bind(c, shape)


def split_address(street: Column, postal_city: Column, town: Column, building: Column, apartment: Column, postal_code: Column) -> Column:
    """struct<street, building, apartment, city, postal_city, postal_code> from a record's columns.

    A full line may stand in any of street, postal_city and city, and is taken apart in this order. A value that a column of
    its own gives stays; a column that held a full line gives no value itself.
    """
    # Every step is bound once, so that later steps refer to it and don't repeat it.
    lines = F.transform(F.array(*(compact(c) for c in (street, postal_city, town))), lambda x: F.struct(x.alias("own"), parse_line(x).alias("full")))
    parts = lambda x: F.struct(x["own"].alias("own"), x["full"].alias("full"), F.when(x["full"].isNotNull(), parse_street(x["full"]["street_part"])).alias("s"), F.when(x["full"].isNotNull(), city(x["full"]["town"])).alias("city"))
    given = F.struct(compact(building).alias("building"), compact(apartment).alias("apartment"), compact(postal_code).alias("postal_code"))

    def merge(v: Column) -> Column:
        rows = v["rows"]
        at = lambda k: F.element_at(rows, k + 1)
        repeated = lambda x: F.exists(rows, lambda y: y["full"].isNotNull() & (y["own"] == x))
        own = lambda k: F.when(~repeated(at(k)["own"]), at(k)["own"])
        plain = v["plain"]
        first = lambda f: F.try_element_at(F.filter(F.transform(rows, f), lambda x: x.isNotNull()), F.lit(1))
        numbered = F.filter(F.transform(rows, lambda x: F.when(x["s"]["building"].isNotNull(), x["s"]["street"])), lambda x: x.isNotNull())
        bare_number = at(0)["full"].isNull() & plain["street"].isNull()
        return F.struct(
            F.coalesce(F.try_element_at(numbered, F.lit(-1)), F.when(plain["building"].isNotNull(), plain["street"]), F.when(~bare_number, own(0)), plain["street"], first(lambda x: x["s"]["street"])).alias("street"),
            F.coalesce(v["given"]["building"], plain["building"], first(lambda x: x["s"]["building"])).alias("building"),
            F.coalesce(v["given"]["apartment"], plain["apartment"], first(lambda x: x["s"]["apartment"])).alias("apartment"),
            F.coalesce(own(2), first(lambda x: x["city"])).alias("city"),
            own(1).alias("postal_city"),
            F.coalesce(v["given"]["postal_code"], first(lambda x: x["full"]["postal_code"])).alias("postal_code"),
        )

    with_parts = lambda rows: F.struct(rows.alias("rows"), bind(F.element_at(rows, 1), lambda x: F.when(x["full"].isNull(), parse_street(x["own"]))).alias("plain"), given.alias("given"))
    return bind(bind(F.transform(lines, parts), with_parts), merge)


def full_address(street: Column, building: Column, apartment: Column, postal_code: Column, town: Column, country: Column) -> Column:
    number = F.nullif(F.concat_ws("/", F.nullif(building, F.lit("")), F.nullif(apartment, F.lit(""))), F.lit(""))
    return compact(F.concat_ws(" ", street, number, postal_code, town, country))
