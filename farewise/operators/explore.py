"""Exploratory counts and top-k tables.

Every count is a partial (map-side) + final hash aggregate, so a location that
holds a third of all trips still ships one partial row per task.  Zone-level
counts aggregate by location id *before* the zone join, so the join sees one
row per location instead of one per trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.operators.joins import join_dimension


def trips_per_hour(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pickup_hour").agg(F.count(F.lit(1)).alias("num_trips"))


def trips_per_location(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pulocationid").agg(F.count(F.lit(1)).alias("trip_nums"))


def best_pickup_locations(trips: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` pickup locations by trip count (ties: lower id first)."""
    return (
        trips.groupBy("pulocationid")
        .agg(F.count("pulocationid").alias("count"))
        .orderBy(F.col("count").desc(), F.col("pulocationid").asc_nulls_first())
        .limit(n)
    )


def pickups_per_zone(trips: DataFrame, zone_pts: DataFrame) -> DataFrame:
    """Trips per zone name, including the null group of trips without a zone."""
    per_loc = trips.groupBy("pulocationid").agg(F.count(F.lit(1)).alias("n"))
    dim = zone_pts.select("locationid", "zone")
    joined = join_dimension(per_loc, dim, "pulocationid", "locationid", "left")
    return joined.groupBy("zone").agg(F.sum("n").alias("count"))


def top_pickup_zones(trips: DataFrame, zone_pts: DataFrame, n: int = 10) -> DataFrame:
    return (
        pickups_per_zone(trips, zone_pts)
        .orderBy(F.col("count").desc(), F.col("zone").asc_nulls_first())
        .limit(n)
    )
