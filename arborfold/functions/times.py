"""Days and months in UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def utc_date(at: Column) -> Column:
    """The UTC date of a timestamp."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(at) / F.lit(DAY_US).cast("decimal(20,0)")).cast("int"))


def utc_month(at: Column) -> Column:
    """The UTC month of a timestamp as YYYY-MM."""
    return F.date_format(utc_date(at), "yyyy-MM")
