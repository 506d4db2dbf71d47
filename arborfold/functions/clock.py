"""The present time as a column, and clocks for tests."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import Column
from pyspark.sql import functions as F


def now_millis() -> Column:
    """Milliseconds since 1970 of the query's time, the same for all its rows."""
    return F.unix_millis(F.current_timestamp())


def now_seconds() -> Column:
    return F.unix_seconds(F.current_timestamp())


def rfc3339(millis: Column) -> Column:
    """A time in milliseconds as text in UTC, such as 2025-01-02T03:04:05.678Z."""
    at = F.timestamp_micros(millis * 1000)
    day, rest = F.floor(millis / F.lit(86_400_000)), F.pmod(millis, F.lit(86_400_000))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    parts = (F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60, rest % 1000)
    return F.when(at.isNotNull(), F.format_string("%sT%02d:%02d:%02d.%03dZ", date, *parts))


class SystemClock:
    """The machine's time."""

    def now_millis(self) -> int:
        return time.time_ns() // 1_000_000

    def now_seconds(self) -> int:
        return self.now_millis() // 1000

    def now_rfc3339(self) -> str:
        at = datetime.datetime.fromtimestamp(self.now_millis() / 1000, datetime.UTC)
        return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{self.now_millis() % 1000:03d}Z"


class FixedClock(SystemClock):
    """A clock that starts at a given time and moves on by `step` milliseconds at each reading, or stands while it is held."""

    def __init__(self, millis: int, step: int = 1) -> None:
        self.millis, self.step, self.held = millis, step, False

    def now_millis(self) -> int:
        at = self.millis
        if not self.held:
            self.millis += self.step
        return at

    def now_rfc3339(self) -> str:
        at = self.now_millis()
        whole = datetime.datetime.fromtimestamp(at // 1000, datetime.UTC)
        return whole.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at % 1000:03d}Z"

    def advance(self, millis: int) -> None:
        self.millis += millis

    def hold(self, on: bool = True) -> None:
        self.held = on
