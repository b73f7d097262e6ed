"""Checks of what callers give: each returns the normalised value, or null where it isn't valid.

A null stays null; only ``score`` counts it as valid, as scores may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ACCESSION, SIC_LEAST, SIC_MOST = r"[0-9]{10}-[0-9]{2}-[0-9]{6}", 100, 9999


def cik(x: Column) -> Column:
    """Up to ten digits, padded with zeros."""
    x = F.trim(x)
    return F.when(x.rlike(r"^[0-9]{1,10}\z"), F.lpad(x, 10, "0"))


def accession(x: Column) -> Column:
    return F.when(F.trim(x).rlike(rf"^{ACCESSION}\z"), F.trim(x))


def accession_within(x: Column) -> Column:
    """The first accession number in a longer string, such as a synthetic key."""
    return F.nullif(F.regexp_extract(x, ACCESSION, 0), F.lit(""))


def sic(x: Column) -> Column:
    """One to four digits, padded, from 0100 to 9999."""
    x = F.trim(x)
    padded = F.when(x.rlike(r"^[0-9]{1,4}\z"), F.lpad(x, 4, "0"))
    return F.when(padded.cast("int").between(SIC_LEAST, SIC_MOST), padded)


def date(x: Column) -> Column:
    """A day of the calendar as YYYY-MM-DD."""
    return F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(x, "yyyy-MM-dd"))


def ordered(start: Column, end: Column) -> Column:
    return F.coalesce(start <= end, F.lit(False))


def one_of(x: Column, values: list[str]) -> Column:
    return F.when(x.isin(values), x)


def score(x: Column, least: float = 0.0, most: float = 1.0) -> Column:
    """Whether a score is missing or within bounds; NaN is neither."""
    return F.when(x.isNull(), True).otherwise(x.between(least, most))
