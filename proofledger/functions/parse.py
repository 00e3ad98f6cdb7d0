"""Parsing of the text columns of a raw record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: text formats of the raw record ----
MONTH_FORMAT = "yyyy-MM"
MONTH_TEXT = "^[0-9]{4}-[0-9]{2}$"
STOREY_LOW = "^([0-9]+)"
STOREY_HIGH = "TO ([0-9]+)$"
LEASE_YEARS = "^([0-9]+) year"
LEASE_MONTHS = "([0-9]+) month"
LEASE_TEXT = "^[0-9]+ years?( [0-9]{1,2} months?)?$"


def month_date(month: Column) -> Column:
    """First day of a strict ``YYYY-MM`` text, NULL for anything else."""
    return F.to_date(F.try_to_timestamp(month, F.lit(MONTH_FORMAT)))


def matched_int(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def lease_years(text: Column) -> Column:
    months = F.coalesce(matched_int(text, LEASE_MONTHS), F.lit(0))
    return matched_int(text, LEASE_YEARS) + months / F.lit(12.0)


def lease_is_valid(text: Column) -> Column:
    months = F.coalesce(matched_int(text, LEASE_MONTHS), F.lit(0))
    return F.coalesce(text.rlike(LEASE_TEXT) & (months <= 11), F.lit(False))


def year_text(day: Column) -> Column:
    return F.date_format(day, "yyyy")
