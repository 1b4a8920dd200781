"""Time-of-day window: trips picked up within ±``window_minutes`` of a request
time, on any date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.functions.timeofday import (
    MINUTES_PER_DAY,
    minute_of_day,
    parse_time_of_day,
    signed_minute_diff,
)


def _minute_col(trips: DataFrame):
    if "pickup_minute" in trips.columns:
        return F.col("pickup_minute")
    return minute_of_day("tpep_pickup_datetime")


def time_window(
    trips: DataFrame,
    time: str,
    window_minutes: int = 30,
    wrap_midnight: bool = False,
) -> DataFrame:
    """Keep trips whose pickup minute of day is within the window; adds
    ``time_diff`` (trip minus request, minutes).

    The predicate is written as ranges on ``pickup_minute`` plus the implied
    range on ``pickup_hour``, so on curated trips (partitioned by hour, sorted
    by minute) it prunes hour folders and skips row groups."""
    user = parse_time_of_day(time)
    minute = _minute_col(trips)
    lo, hi = user - window_minutes, user + window_minutes
    if not wrap_midnight or (lo >= 0 and hi < MINUTES_PER_DAY):
        ranges = [(max(lo, 0), min(hi, MINUTES_PER_DAY - 1))]
    elif window_minutes * 2 + 1 >= MINUTES_PER_DAY:
        ranges = [(0, MINUTES_PER_DAY - 1)]
    elif lo < 0:
        ranges = [(0, hi), (lo + MINUTES_PER_DAY, MINUTES_PER_DAY - 1)]
    else:
        ranges = [(lo, MINUTES_PER_DAY - 1), (0, hi - MINUTES_PER_DAY)]
    cond = None
    for a, b in ranges:
        part = minute.between(a, b)
        if "pickup_hour" in trips.columns:
            part = part & F.col("pickup_hour").between(a // 60, b // 60)
        cond = part if cond is None else (cond | part)
    return trips.filter(cond).withColumn(
        "time_diff", signed_minute_diff(minute, user, wrap_midnight)
    )
