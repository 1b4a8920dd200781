"""Trips enriched with their pickup zone; borough predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.operators.joins import join_dimension

ZONE_COLUMNS = ("locationid", "zone", "borough", "long", "lat")


def attach_zones(
    trips: DataFrame, zone_pts: DataFrame, how: str = "left", salt_buckets: int | None = None
) -> DataFrame:
    """Join on ``pulocationid = locationid``; ``left`` (default) keeps trips
    without a zone with null zone columns, ``inner`` drops them.  Lazy: no job
    runs here.  ``salt_buckets``: see ``join_dimension``."""
    dim = zone_pts.select(*ZONE_COLUMNS)
    return join_dimension(trips, dim, "pulocationid", "locationid", how, salt_buckets)


def normalise_borough(c: Column) -> Column:
    # A leading "the " is dropped on both sides, so "The Bronx" matches "Bronx".
    return F.regexp_replace(F.lower(F.trim(c)), r"^the\s+", "")


def borough_matches(col: Column | str, borough: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return normalise_borough(c) == normalise_borough(F.lit(borough))


def filter_borough(df: DataFrame, borough: str | None, col: str = "borough") -> DataFrame:
    """Case-insensitive borough equality; no borough (None or '') keeps all rows."""
    if not borough or not borough.strip():
        return df
    return df.filter(borough_matches(col, borough))


def with_point(df: DataFrame) -> DataFrame:
    """Rows whose zone point is known (a trip without a zone has no features)."""
    return df.filter(
        F.col("long").isNotNull() & F.col("lat").isNotNull()
        & ~F.isnan("long") & ~F.isnan("lat")
    )
