"""Checks of identifiers, names, mail addresses and dates; a check is true or false and never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the check sums.
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON_WEIGHTS = (8, 9, 2, 3, 4, 5, 6, 7)
REGON_14_WEIGHTS = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)
ID_CARD_WEIGHTS = (7, 3, 1, 7, 3, 1, 7, 3)
CENTURIES = ((80, 1800), (0, 1900), (20, 2000), (40, 2100), (60, 2200))
PERSON_NAME = r"^[A-ZĄĆĘŁŃÓŚŹŻ][A-ZĄĆĘŁŃÓŚŹŻ '\-]*$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def digit(c: Column, k: int) -> Column:
    """The k-th digit (from 0); null where there is none."""
    return F.substring(c, k + 1, 1).try_cast("int")


def weighted(c: Column, weights: tuple[int, ...]) -> Column:
    return sum((digit(c, k) * w for k, w in enumerate(weights)), F.lit(0))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def optional(c: Column, check: Column) -> Column:
    return blank(c) | _sure(check)


def pesel(c: Column) -> Column:
    return _sure(F.when(c.rlike(r"^\d{11}$"), (10 - weighted(c, PESEL_WEIGHTS) % 10) % 10 == digit(c, 10)))


def nip(c: Column) -> Column:
    return _sure(F.when(c.rlike(r"^\d{10}$"), weighted(c, NIP_WEIGHTS) % 11 == digit(c, 9)))


def regon(c: Column) -> Column:
    nine = weighted(c, REGON_WEIGHTS) % 11 % 10 == digit(c, 8)
    return _sure(F.when(c.rlike(r"^\d{9}$"), nine).when(c.rlike(r"^\d{14}$"), nine & (weighted(c, REGON_14_WEIGHTS) % 11 % 10 == digit(c, 13))))


def lei(c: Column) -> Column:
    """ISO 7064 mod 97-10, folded over the characters so that no large number arises."""
    code = F.upper(F.trim(c))
    step = lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + x.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)
    return _sure(F.when(code.rlike("^[0-9A-Z]{20}$"), F.aggregate(F.split(code, ""), F.lit(0), step) == 1))


def id_card(c: Column) -> Column:
    """Three letters and six digits, of which the first is the check digit."""
    code = F.upper(F.trim(c))
    values = [F.ascii(F.substring(code, k + 1, 1)) - 55 for k in range(3)] + [digit(code, k) for k in range(4, 9)]
    total = sum((v * w for v, w in zip(values, ID_CARD_WEIGHTS)), F.lit(0))
    return _sure(F.when(code.rlike(r"^[A-Z]{3}\d{6}$"), total % 10 == digit(code, 3)))


def krs(c: Column) -> Column:
    return _sure(c.rlike(r"^\d{10}$"))


def person_name(c: Column) -> Column:
    return _sure(c.rlike(PERSON_NAME))


def non_empty(c: Column) -> Column:
    return _sure(F.length(F.trim(c)) > 0)


def email(c: Column) -> Column:
    return _sure(c.rlike(EMAIL))


def pesel_birth_date(c: Column) -> Column:
    """Birth date in a number of eleven digits; the month says the century."""
    two = lambda k: F.substring(c, k, 2).try_cast("int")
    day = lambda off, century: F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", two(1) + century, two(3) - off, two(5)), F.lit("yyyy-MM-dd")))
    found = F.coalesce(*(F.when((two(3) - off).between(1, 12), day(off, century)) for off, century in CENTURIES))
    return F.when(c.rlike(r"^\d{11}$"), found)


def pesel_is_female(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{11}$"), digit(c, 9) % 2 == 0)


def pesel_birth_date_matches(c: Column, birth_date: Column) -> Column:
    born = pesel_birth_date(c)
    return born.isNotNull() & (birth_date.isNull() | _sure(born == birth_date))


def pesel_sex_matches(c: Column, female: Column) -> Column:
    return female.isNull() | _sure(pesel_is_female(c) == female)


def not_later(day: Column, today: Column) -> Column:
    return F.coalesce(day <= today, F.lit(True))


def in_order(start: Column, end: Column) -> Column:
    return F.coalesce(start <= end, F.lit(True))
