"""Signing dates, fiscal years that begin on 1 July, and month numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse

_DATE = "^\\d{1,2}/\\d{1,2}/\\d{4}$"


def signing_date(c: Column | str) -> Column:
    """The date of a text month/day/year; NULL for any other text."""
    c = collapse(c)
    return F.when(c.rlike(_DATE), F.try_to_date(c, "M/d/yyyy"))


def fiscal_year(d: Column | str) -> Column:
    return F.year(col(d)) + F.when(F.month(col(d)) >= 7, 1).otherwise(0)


def fiscal_year_start(fy: Column | str) -> Column:
    return F.make_date(col(fy) - 1, F.lit(7), F.lit(1))


def days_into_fiscal_year(d: Column | str) -> Column:
    return F.datediff(col(d), fiscal_year_start(fiscal_year(d)))


def quarter(days: Column | str) -> Column:
    """Spans of 91 days; the fourth takes the rest."""
    return F.least(F.floor(col(days) / 91) + 1, F.lit(4)).cast("int")


def month_number(d: Column | str) -> Column:
    return F.year(col(d)) * 12 + F.month(col(d)) - 1


def month_year(m: Column | str) -> Column:
    """The fiscal year of a month number."""
    return (F.floor(col(m) / 12) + F.when(F.pmod(col(m), F.lit(12)) + 1 >= 7, 1).otherwise(0)).cast("int")
