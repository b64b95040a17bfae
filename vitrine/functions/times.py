"""Calendar parts that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with time zone; null stays null."""
    return F.unix_micros(ts)


def utc_day(ts: Column) -> Column:
    """Days since the epoch (int) of the UTC date of a timestamp with time zone."""
    us = F.unix_micros(ts)
    return ((us - F.pmod(us, F.lit(DAY_US))) / F.lit(DAY_US)).cast("int")


def utc_month(ts: Column) -> Column:
    """The UTC month as text, 'YYYY-MM'."""
    return F.date_format(F.date_from_unix_date(utc_day(ts)), "yyyy-MM")
