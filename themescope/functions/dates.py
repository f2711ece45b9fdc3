"""Dates in mixed ISO spellings; the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from themescope.fixed_values import DAY_FORMAT, ISO_DAY_PREFIX


def parse_utc(text: Column) -> Column:
    """Timestamp of ``yyyy-MM-dd`` or a full ISO instant; NULL for anything else."""
    return F.when(text.rlike(ISO_DAY_PREFIX), text.try_cast("timestamp"))


def month_of(when: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(when.cast("date"), "month")


def day_text(when: Column) -> Column:
    return F.date_format(when, DAY_FORMAT)


def year_month(when: Column) -> Column:
    """``yyyy-MM`` prefix of a day."""
    return F.substring(day_text(when), 1, 7)
