"""Fixture views that stand in for taxi trips and taxi zones.

The driver's tables carry no taxi data, so ``events`` plays trips and
``nation JOIN region`` plays zones (regions are boroughs).  The same SQL text
runs in Spark SQL (tables bound as DataFrame arguments) and in DuckDB (tables
are views of the same name), so both engines see identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The two fixture views (see FIXTURES.md).
TRIPS_FX = """
SELECT event_id AS trip_id,
       ts AS tpep_pickup_datetime,
       ts + INTERVAL '17' MINUTE AS tpep_dropoff_datetime,
       CASE WHEN event_type = 'error' THEN NULL
            ELSE CAST(event_id % 7 AS DOUBLE) + 0.5 END AS passenger_count,
       value / 10 AS trip_distance,
       user_id % 30 AS pulocationid,
       event_id % 25 AS dolocationid,
       round(value * 0.2, 2) AS tip_amount,
       value AS total_amount
FROM {events}
"""

ZONES_FX = """
SELECT CAST(n_nationkey AS VARCHAR(10)) AS locationid,
       n_name AS zone,
       r_name AS borough,
       'MULTIPOLYGON (((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', '
         || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || ')))' AS the_geom
FROM (
  SELECT n_nationkey, n_name, r_name,
         CAST(CAST(-74.25 + 0.15 * n_regionkey + 0.002 * n_nationkey AS DECIMAL(10,4)) AS VARCHAR(20)) AS x0,
         CAST(CAST(-74.25 + 0.15 * n_regionkey + 0.002 * n_nationkey + 0.001 AS DECIMAL(10,4)) AS VARCHAR(20)) AS x1,
         CAST(CAST(40.5 + 0.1 * ((n_regionkey * 2) % 5) + 0.001 * n_nationkey AS DECIMAL(10,4)) AS VARCHAR(20)) AS y0,
         CAST(CAST(40.5 + 0.1 * ((n_regionkey * 2) % 5) + 0.001 * n_nationkey + 0.001 AS DECIMAL(10,4)) AS VARCHAR(20)) AS y1
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
) q
"""

# Requests of many users: the customers, each with a time, a position and, for every third, a borough.
REQUESTS_FX = """
SELECT c_custkey AS request_id,
       lpad(CAST(CAST(floor(((c_custkey * 37) % 1440) / 60) AS INTEGER) AS VARCHAR(2)), 2, '0') || ':'
         || lpad(CAST((c_custkey * 37) % 60 AS VARCHAR(2)), 2, '0') AS time,
       40.5e0 + (c_custkey % 97) * 0.006e0 AS lat,
       -74.3e0 + (c_custkey % 89) * 0.009e0 AS long,
       CASE WHEN c_custkey % 3 = 0 THEN 'the ' || lower(r_name) END AS borough
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Places scattered over a city, or over the globe: centres from ``part``, points from
# ``orders`` and users from ``customer``.
CENTRES_FX = """
SELECT p_partkey AS center_id,
       -74.3e0 + 0.8e0 * ((p_partkey * 7919) % 10007) / 10007e0 AS center_long,
       40.4e0 + 0.6e0 * ((p_partkey * 104729) % 10009) / 10009e0 AS center_lat
FROM {part}
"""
POINTS_FX = """
SELECT o_orderkey AS trip_id,
       -74.4e0 + 1e0 * ((o_custkey * 6007) % 9973) / 9973e0 AS long,
       40.3e0 + 0.8e0 * ((o_custkey * 7001) % 9967) / 9967e0 AS lat
FROM {orders}
"""
GLOBE_CENTRES_FX = """
SELECT p_partkey AS center_id,
       -180e0 + 360e0 * ((p_partkey * 7919) % 10007) / 10007e0 AS center_long,
       -90e0 + 180e0 * ((p_partkey * 104729) % 10009) / 10009e0 AS center_lat
FROM {part}
"""
GLOBE_USERS_FX = """
SELECT c_custkey AS user_id,
       -180e0 + 360e0 * ((c_custkey * 6007) % 9973) / 9972e0 AS long,
       -90e0 + 180e0 * ((c_custkey * 7001) % 9967) / 9966e0 AS lat
FROM {customer}
"""

# Weighted points without any gap between clusters, and five starting centres.
OVERLAP_FX = """
SELECT -74.3e0 + 0.8e0 * ((c_custkey * 7919) % 10007) / 10007e0 AS long,
       40.4e0 + 0.6e0 * ((c_custkey * 104729) % 10009) / 10009e0 AS lat,
       1 + c_custkey % 9 AS n
FROM {customer}
"""
STARTS_FX = """
SELECT r_regionkey AS cluster, -74.25e0 + 0.15e0 * r_regionkey AS center_long,
       40.5e0 + 0.1e0 * ((r_regionkey * 2) % 5) AS center_lat
FROM {region}
"""

# Schemaless records whose fields come, go and change their type.
RECORDS_FX = """
SELECT event_id AS record_no,
       '{{"trip_id": ' || CAST(event_id AS VARCHAR(20))
         || CASE WHEN event_id % 4 = 1 THEN ', "fare": "' || event_type || '"' WHEN event_id % 4 = 2 THEN ', "fare": null'
                 ELSE ', "fare": ' || CAST(user_id AS VARCHAR(20)) || '.5' END
         || CASE WHEN event_id % 3 = 0 THEN ', "tip": true' WHEN event_id % 3 = 1 THEN ', "tip": ' || CAST(user_id AS VARCHAR(20)) ELSE '' END
         || CASE WHEN event_id % 7 = 3 THEN ', "stops": [1, "x"]' WHEN event_id % 7 = 5 THEN ', "stops": {{"n": 2}}' ELSE '' END
         || CASE WHEN event_id % 11 = 9 THEN '' ELSE '}}' END AS record
FROM {events}
"""

# Request fixtures: a position in the middle of the blobs, the times of FIXTURES.md.
USER_LAT = 40.70
USER_LONG = -73.95
TIMES = ("15:00:00", "08:15:00", "00:10:00", "23:45:00")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips as a source would deliver them (before cleaning)."""
    return spark.sql(TRIPS_FX, events=read_table(spark, sf_dir, "events"))


def raw_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones as the headered CSV would deliver them: every column a string."""
    return spark.sql(
        ZONES_FX,
        nation=read_table(spark, sf_dir, "nation"),
        region=read_table(spark, sf_dir, "region"),
    )


def stand_in(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the statements above over the driver's tables."""
    names = re.findall(r"(?<!\{)\{(\w+)\}", text)
    return spark.sql(text, **{n: read_table(spark, sf_dir, n) for n in names})


def duckdb_text(text: str) -> str:
    """The same statement for DuckDB."""
    return re.sub(r"(?<!\{)\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")


def duckdb_views() -> str:
    """``WITH`` prefix defining ``trips`` and ``zones`` for the DuckDB oracle."""
    trips = TRIPS_FX.format(events="events")
    zones = ZONES_FX.format(nation="nation", region="region")
    return f"WITH trips AS ({trips}), zones AS ({zones})"
