"""Time helpers that stay independent of the session time zone.

Test and health tables carry ``TIMESTAMP_NTZ`` columns; literals are built
from strings so no time zone is applied on the way in.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F

MICROS_PER_SECOND = 1_000_000.0
MICROS_PER_DAY = 86_400_000_000.0


def ts_ntz(value) -> Column:
    """A ``timestamp_ntz`` Column from a string, date/datetime or Column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """``end - start`` in seconds as double (microsecond exact)."""
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / F.lit(MICROS_PER_SECOND)


def whole_days_between(start: Column, end: Column) -> Column:
    """Whole days of ``end - start``, floored (like a timedelta's ``days``)."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS_PER_DAY))


def days_since_epoch(t: Column) -> Column:
    """Fractional days since 1970-01-01 (x axis of the trend primitive)."""
    return F.timestamp_diff("MICROSECOND", ts_ntz("1970-01-01 00:00:00"), t).cast("double") \
        / F.lit(MICROS_PER_DAY)
