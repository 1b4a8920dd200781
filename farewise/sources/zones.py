"""Zone dimension: the headered CSV (all strings) and the derived zone points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.functions.geo import vertex_center, wkt_vertices
from farewise.sources.trips import normalize_columns


def read_zones_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV, every column read as a string (no schema inference pass);
    quoted WKT keeps its commas and line breaks, for which each file is one task:
    fit for a dimension, not for facts.  Column names are lower-cased."""
    return normalize_columns(
        spark.read.option("header", True).option("inferSchema", False)
        .option("multiLine", True).csv(path)
    )


def zone_vertices(zones: DataFrame) -> DataFrame:
    """``locationid`` (bigint), ``zone``, ``borough``, ``vertices``."""
    return zones.select(
        F.col("locationid").try_cast("bigint").alias("locationid"),
        F.col("zone"),
        F.col("borough"),
        wkt_vertices("the_geom").alias("vertices"),
    )


def zone_points(zones: DataFrame) -> DataFrame:
    """One point per zone: the vertex mean of its geometry.

    ``locationid, zone, borough, long, lat, n_vertices``; the point is null when
    the geometry is null or has no coordinate pair."""
    v = zone_vertices(zones)
    center = vertex_center("vertices")
    return v.select(
        "locationid",
        "zone",
        "borough",
        F.get(center, 0).alias("long"),
        F.get(center, 1).alias("lat"),
        F.size("vertices").alias("n_vertices"),
    )
