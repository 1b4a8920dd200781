"""Cleaning of raw trips: drop incomplete rows, type the two numeric columns,
derive the time parts every later query filters or groups on.

Times are local times without a zone (``TIMESTAMP_NTZ``).  A source that delivers
instants (``TIMESTAMP``) is converted under a named zone, never under the
session's, so hours and windows do not depend on who asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from farewise.functions.timeofday import minute_of_day, wall_clock

TIME_COLUMNS = ("tpep_pickup_datetime", "tpep_dropoff_datetime")
SOURCE_ZONE = "UTC"


def to_wall_clock(df: DataFrame, zone: str = SOURCE_ZONE) -> DataFrame:
    """Trip times that are instants become local times in ``zone``."""
    instants = [f.name for f in df.schema if f.name in TIME_COLUMNS and isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: wall_clock(c, zone) for c in instants}) if instants else df


# What ``clean_trips`` leaves: the derived columns, and the two it casts, with their types.
CLEAN_COLUMNS = {
    "pickup_hour": T.IntegerType(), "dropoff_hour": T.IntegerType(), "pickup_minute": T.IntegerType(),
    "passenger_count": T.IntegerType(), "trip_distance": T.FloatType(),
}


def is_clean(df: DataFrame) -> bool:
    """Whether ``df`` looks like what ``clean_trips`` returns: all its derived columns with
    their types, every cast column that is still there with its type, and local times."""
    types = {f.name: f.dataType for f in df.schema}
    derived = ("pickup_hour", "dropoff_hour", "pickup_minute")
    if any(types.get(c) != CLEAN_COLUMNS[c] for c in derived):
        return False
    if any(c in types and types[c] != t for c, t in CLEAN_COLUMNS.items()):
        return False
    return not any(isinstance(types.get(c), T.TimestampType) for c in TIME_COLUMNS)


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop a row when any column (or any of ``subset``) is null or NaN."""
    return df.dropna(how="any", subset=subset)


def cast_trip_types(df: DataFrame) -> DataFrame:
    """Passenger count to int (fraction truncated, overflow to null) and trip
    distance to float."""
    return df.withColumns(
        {
            "passenger_count": F.col("passenger_count").try_cast("int"),
            "trip_distance": F.col("trip_distance").try_cast("float"),
        }
    )


def add_time_parts(df: DataFrame) -> DataFrame:
    """``pickup_hour``, ``dropoff_hour`` and ``pickup_minute`` (minute of day).

    ``pickup_minute`` is stored by ``load_trips`` so that a time-of-day window is a
    plain range predicate the Parquet reader can push down."""
    return df.withColumns(
        {
            "pickup_hour": F.hour("tpep_pickup_datetime"),
            "dropoff_hour": F.hour("tpep_dropoff_datetime"),
            "pickup_minute": minute_of_day("tpep_pickup_datetime"),
        }
    )


def clean_trips(df: DataFrame, zone: str = SOURCE_ZONE) -> DataFrame:
    """Raw (lower-case) trips → cleaned trips with time parts; ``zone``: that of
    times delivered as instants."""
    return add_time_parts(cast_trip_types(drop_incomplete(to_wall_clock(df, zone))))
