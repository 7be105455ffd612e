"""Lenient dates. Dashed and slashed dates that start with the year are read as year, day, month first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _date(text: Column, pattern: str, shape: str) -> Column:
    return F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(pattern))))


def lenient_date(c: Column, order: str = "YDM") -> Column:
    """Date of a text in any of the known forms, else null. order "ISO" reads year-month-day first instead."""
    text = F.trim(c.cast("string"))
    ten, dashed = F.substring(text, 1, 10), F.substring(F.replace(text, F.lit("/"), F.lit("-")), 1, 10)
    year_first = r"^\d{4}-\d{2}-\d{2}$"
    plain = ~text.contains("T")
    swapped = [F.when(plain, _date(x, "yyyy-dd-MM", year_first)) for x in (ten, dashed)] if order == "YDM" else [F.lit(None).cast("date")] * 2
    iso = [_date(x, "yyyy-MM-dd", year_first) for x in (ten, dashed)]
    return F.coalesce(
        F.when(text.rlike(r"^\d{8}(\d{4}|\d{6})?$"), _date(F.substring(text, 1, 8), "yyyyMMdd", r"^\d{8}$")),
        swapped[0],
        iso[0],
        swapped[1],
        iso[1],
        _date(ten, "dd.MM.yyyy", r"^\d{2}\.\d{2}\.\d{4}$"),
        _date(ten, "dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
        _date(ten, "dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
        _date(ten, "yyyy/dd/MM", r"^\d{4}/\d{2}/\d{2}$"),
    )
