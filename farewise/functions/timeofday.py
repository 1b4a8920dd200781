"""Time-of-day helpers.

A request time is parsed once on the driver to minutes after midnight (seconds
are ignored, as in the hour/minute comparison it replaces); trip timestamps are
compared through their minute of day, so the date never matters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440
_TIME_RE = re.compile(r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$")


def parse_time_of_day(value: str) -> int:
    """``'HH:MM'`` or ``'HH:MM:SS'`` → minutes after midnight; ValueError otherwise."""
    m = _TIME_RE.match(value or "")
    if not m:
        raise ValueError(f"time of day must look like HH:MM or HH:MM:SS, got {value!r}")
    hours, minutes, seconds = int(m.group(1)), int(m.group(2)), int(m.group(3) or 0)
    if hours > 23 or minutes > 59 or seconds > 59:
        raise ValueError(f"time of day out of range: {value!r}")
    return hours * 60 + minutes


def wall_clock(ts: Column | str, zone: str = "UTC") -> Column:
    """An instant (``TIMESTAMP``) as the local time (``TIMESTAMP_NTZ``) in
    ``zone``.  Counts microseconds from the epoch, so the session time zone
    plays no part."""
    c = F.col(ts) if isinstance(ts, str) else ts
    seconds = (F.unix_micros(c).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.lit(0)
    utc = epoch + F.make_dt_interval(zero, zero, zero, seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def minute_of_day(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.hour(c) * 60 + F.minute(c)


def signed_minute_diff(minute: Column | str, user_minute: int, wrap_midnight: bool = False) -> Column:
    """Trip minute minus request minute.  Without wrapping, 23:45 and 00:05 are
    1420 minutes apart; with wrapping the difference is taken on the circle,
    in ``[-720, 720)``."""
    c = F.col(minute) if isinstance(minute, str) else minute
    diff = c - F.lit(user_minute)
    if wrap_midnight:
        half = MINUTES_PER_DAY // 2
        return F.pmod(diff + F.lit(half), F.lit(MINUTES_PER_DAY)) - F.lit(half)
    return diff
