"""DuckDB twins of the catalog plans (the correctness oracle).

Each statement starts from the same fixture views as the Spark side.  k-means
has no SQL form; on the fixture the zones form five well separated blobs, one
per borough, so k = 5 recovers the boroughs and the oracle groups by borough
(by zone when one borough is selected: five zones, five clusters)."""

from __future__ import annotations

from farewise.fixtures import (
    CENTRES_FX,
    GLOBE_CENTRES_FX,
    GLOBE_USERS_FX,
    OVERLAP_FX,
    POINTS_FX,
    RECORDS_FX,
    REQUESTS_FX,
    STARTS_FX,
    USER_LAT,
    USER_LONG,
    duckdb_text,
    duckdb_views,
)
from farewise.functions.geo import EARTH_RADIUS_MI, WKT_PAIR_PATTERN
from farewise.functions.timeofday import parse_time_of_day

D = 6  # rounding digits, as on the Spark side

_CLEAN = r"""
, clean AS (
  SELECT trip_id, tpep_pickup_datetime, tpep_dropoff_datetime,
         CAST(trunc(passenger_count) AS INTEGER) AS passenger_count,
         CAST(trip_distance AS FLOAT) AS trip_distance,
         pulocationid, dolocationid, tip_amount, total_amount,
         CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
         CAST(hour(tpep_dropoff_datetime) AS INTEGER) AS dropoff_hour,
         CAST(hour(tpep_pickup_datetime) * 60 + minute(tpep_pickup_datetime) AS INTEGER) AS pickup_minute
  FROM complete)
"""

_COMPLETE = """
, complete AS (
  SELECT * FROM trips
  WHERE trip_id IS NOT NULL AND tpep_pickup_datetime IS NOT NULL
    AND tpep_dropoff_datetime IS NOT NULL
    AND passenger_count IS NOT NULL AND NOT isnan(passenger_count)
    AND trip_distance IS NOT NULL AND NOT isnan(trip_distance)
    AND pulocationid IS NOT NULL AND dolocationid IS NOT NULL
    AND tip_amount IS NOT NULL AND NOT isnan(tip_amount)
    AND total_amount IS NOT NULL AND NOT isnan(total_amount))
"""

_ZONES = f"""
, zone_v AS (
  SELECT TRY_CAST(locationid AS BIGINT) AS locationid, zone, borough,
         list_transform(regexp_extract_all(the_geom, '{WKT_PAIR_PATTERN}', 1),
                        lambda s: list_transform(string_split_regex(s, '\\s'),
                                                 lambda x: CAST(x AS DOUBLE))) AS vertices
  FROM zones)
, zone_pts AS (
  SELECT locationid, zone, borough,
         CASE WHEN len(vertices) > 0
              THEN list_sum(list_transform(vertices, lambda p: p[1])) / len(vertices) END AS long,
         CASE WHEN len(vertices) > 0
              THEN list_sum(list_transform(vertices, lambda p: p[2])) / len(vertices) END AS lat,
         CAST(len(vertices) AS INTEGER) AS n_vertices
  FROM zone_v)
"""

BASE = duckdb_views() + _COMPLETE + _CLEAN + _ZONES


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    r2 = repr(2.0 * EARTH_RADIUS_MI)
    return (
        f"({r2} * asin(sqrt("
        f"sin((radians({lat2}) - radians({lat1})) * 0.5) * sin((radians({lat2}) - radians({lat1})) * 0.5)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * sin((radians({lon2}) - radians({lon1})) * 0.5) * sin((radians({lon2}) - radians({lon1})) * 0.5))))"
    )


def _window(time: str = "15:00:00", wrap: bool = False, borough: str | None = None) -> str:
    u = parse_time_of_day(time)
    diff = f"(c.pickup_minute - {u})"
    if wrap:
        diff = f"(((({diff} + 720) % 1440) + 1440) % 1440 - 720)"
    cond = f"CAST({diff} AS INTEGER) BETWEEN -30 AND 30"
    if borough:
        cond += (
            f" AND regexp_replace(lower(trim(z.borough)), '^the\\s+', '')"
            f" = regexp_replace(lower(trim('{borough}')), '^the\\s+', '')"
        )
    return f"""
, win AS (
  SELECT c.*, CAST({diff} AS INTEGER) AS time_diff, z.zone, z.borough, z.long, z.lat
  FROM clean c LEFT JOIN zone_pts z ON c.pulocationid = z.locationid
  WHERE {cond})
, pts AS (SELECT * FROM win WHERE long IS NOT NULL AND lat IS NOT NULL
          AND NOT isnan(long) AND NOT isnan(lat))
"""


_WINDOW_SELECT = f"""
SELECT tpep_pickup_datetime, tpep_dropoff_datetime, time_diff, trip_distance,
       passenger_count, pulocationid, dolocationid, zone, round(long, {D}) AS long,
       round(lat, {D}) AS lat, round(tip_amount, {D}) AS tip_amount,
       round(total_amount, {D}) AS total_amount
FROM win"""


def _clusters(group: str = "borough") -> str:
    return f"""
, cl AS (
  SELECT avg(long) AS centroid_long, avg(lat) AS centroid_lat,
         avg(total_amount) AS avg_revenue, avg(tip_amount) AS avg_tip,
         CAST(count(*) AS BIGINT) AS trips
  FROM pts GROUP BY {group})
, near AS (
  SELECT *, {_hav('centroid_lat', 'centroid_long', repr(USER_LAT), repr(USER_LONG))} AS distance_mi
  FROM cl)
, top AS (
  SELECT CAST(row_number() OVER (ORDER BY distance_mi, centroid_long, centroid_lat) AS INTEGER) AS rank, *
  FROM near ORDER BY distance_mi, centroid_long, centroid_lat LIMIT 3)
"""


def _hotspot_select(src: str = "top") -> str:
    return f"""
SELECT rank, round(centroid_long, {D}) AS centroid_long, round(centroid_lat, {D}) AS centroid_lat,
       round(avg_revenue, {D}) AS avg_revenue, round(avg_tip, {D}) AS avg_tip, trips,
       round(distance_mi, {D}) AS distance_mi,
       CAST(floor(avg_revenue + avg_tip + 0.5) AS BIGINT) AS expected_price
FROM {src}"""


def _hotspots(time="15:00:00", wrap=False, borough=None) -> str:
    group = "zone" if borough else "borough"
    return BASE + _window(time, wrap, borough) + _clusters(group) + _hotspot_select()


_RAW_SELECT = "SELECT * FROM trips"

SCHEMA_TYPES = """CASE t WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'string'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(t) END"""


def _profile() -> str:
    cols = [
        "trip_id", "tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count",
        "trip_distance", "pulocationid", "dolocationid", "tip_amount", "total_amount",
    ]
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, typeof({c}) AS t FROM sample" for c in cols
    )
    return (
        duckdb_views()
        + f", sample AS (SELECT * FROM trips LIMIT 10), p AS ({parts})"
        + f" SELECT DISTINCT column_name, {SCHEMA_TYPES} AS type_name FROM p"
    )


def _instants_base(minutes: int = 330) -> str:
    """``BASE`` over local times of UTC+05:30."""
    base = BASE.replace("ts AS tpep_pickup_datetime", f"ts + INTERVAL '{minutes}' MINUTE AS tpep_pickup_datetime")
    return base.replace("ts + INTERVAL '17' MINUTE", f"ts + INTERVAL '{minutes + 17}' MINUTE")


def _batch(minutes: int = 30, wrap: bool = False) -> str:
    """Every request with its trips; clusters are boroughs, or the zones of a borough."""
    asked = "CAST(time[1:2] AS INTEGER) * 60 + CAST(time[4:5] AS INTEGER)"
    diff = "(c.pickup_minute - r.minute)"
    if wrap:
        diff = f"(((({diff} + 720) % 1440) + 1440) % 1440 - 720)"
    strip = "regexp_replace(lower(trim({})), '^the\\s+', '')".format
    return BASE + f"""
, requests AS ({duckdb_text(REQUESTS_FX)})
, asked AS (SELECT *, {asked} AS minute, {strip('borough')} AS wanted FROM requests)
, pairs AS (SELECT DISTINCT minute, wanted FROM asked)
, per_minute AS (
  SELECT pulocationid, pickup_minute, count(*) AS n, CAST(sum(total_amount) AS DECIMAL(18,6)) AS total,
         CAST(sum(tip_amount) AS DECIMAL(18,6)) AS tip
  FROM clean GROUP BY ALL)
, cl AS (
  SELECT r.minute, r.wanted, CAST(sum(CAST(z.long AS DECIMAL(18,9)) * c.n) AS DOUBLE) / sum(c.n) AS centroid_long,
         CAST(sum(CAST(z.lat AS DECIMAL(18,9)) * c.n) AS DOUBLE) / sum(c.n) AS centroid_lat,
         CAST(sum(c.total) AS DOUBLE) / sum(c.n) AS avg_revenue, CAST(sum(c.tip) AS DOUBLE) / sum(c.n) AS avg_tip,
         CAST(sum(c.n) AS BIGINT) AS trips
  FROM pairs r JOIN per_minute c ON {diff} BETWEEN -{minutes} AND {minutes}
  JOIN zone_pts z ON c.pulocationid = z.locationid AND (r.wanted IS NULL OR {strip('z.borough')} = r.wanted)
  GROUP BY r.minute, r.wanted, CASE WHEN r.wanted IS NULL THEN z.borough ELSE z.zone END)
, near AS (
  SELECT a.request_id, cl.*, {_hav('centroid_lat', 'centroid_long', 'a.lat', 'a.long')} AS distance_mi
  FROM asked a JOIN cl ON a.minute = cl.minute AND a.wanted IS NOT DISTINCT FROM cl.wanted)
, top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY distance_mi, centroid_long, centroid_lat) AS INTEGER) AS rank
  FROM near QUALIFY rank <= 3)
SELECT request_id, rank, {', '.join(f'floor({c} * 1e{D} + 0.5) / 1e{D} AS {c}' for c in
  ('centroid_long', 'centroid_lat', 'avg_revenue', 'avg_tip', 'distance_mi'))}, trips,
       CAST(floor(avg_revenue + avg_tip + 0.5) AS BIGINT) AS expected_price
FROM top"""


def _lloyd(steps: int = 20) -> str:
    """Lloyd's iterations as a recursive query: one row a centre and step."""
    return f"""
WITH RECURSIVE points AS (
  SELECT long, lat, CAST(sum(n) AS DOUBLE) AS w FROM ({duckdb_text(OVERLAP_FX)}) p GROUP BY long, lat)
, steps AS (
  SELECT 0 AS step, cluster, center_long, center_lat, CAST(0 AS DOUBLE) AS w FROM ({duckdb_text(STARTS_FX)}) s
  UNION ALL
  SELECT c.step + 1, c.cluster, coalesce(m.x, c.center_long), coalesce(m.y, c.center_lat), coalesce(m.w, 0)
  FROM steps c LEFT JOIN (
    SELECT cluster, sum(long * w) / sum(w) AS x, sum(lat * w) / sum(w) AS y, sum(w) AS w FROM (
      SELECT p.long, p.lat, p.w, arg_min(s.cluster, (
        (p.long - s.center_long) * (p.long - s.center_long) + (p.lat - s.center_lat) * (p.lat - s.center_lat), s.cluster)) AS cluster
      FROM points p, steps s GROUP BY p.long, p.lat, p.w) near
    GROUP BY cluster) m ON m.cluster = c.cluster
  WHERE c.step < {steps})
SELECT cluster, round(center_long, {D}) AS center_long, round(center_lat, {D}) AS center_lat, CAST(w AS BIGINT) AS trips
FROM steps WHERE step = {steps}"""


_RAW_COLUMNS = (
    "trip_id", "tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count", "trip_distance",
    "pulocationid", "dolocationid", "tip_amount", "total_amount",
)


def _fails(c: str) -> str:
    number = c in ("passenger_count", "trip_distance", "tip_amount", "total_amount")
    return f"({c} IS NULL OR coalesce(isnan({c}), false))" if number else f"({c} IS NULL)"


def _drop_account() -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST(count(*) FILTER ({_fails(c)}) AS BIGINT) AS failing FROM trips" for c in _RAW_COLUMNS]
    some = " OR ".join(map(_fails, _RAW_COLUMNS))
    parts.append(f"SELECT NULL AS column_name, CAST(count(*) FILTER ({some}) AS BIGINT) AS failing FROM trips")
    return duckdb_views() + " " + " UNION ALL ".join(parts)


def _quarantined() -> str:
    names = ", ".join(f"CASE WHEN {_fails(c)} THEN '{c}' END" for c in _RAW_COLUMNS)
    return duckdb_views() + f"""
SELECT trip_id, pulocationid, concat_ws(',', {names}) AS failing FROM trips
WHERE {' OR '.join(map(_fails, _RAW_COLUMNS))}"""


def _record_profile(sample: str) -> str:
    return f"""
WITH records AS (SELECT * FROM ({duckdb_text(RECORDS_FX)}) r {sample})
, fields AS (
  SELECT record_no, record, unnest(json_keys(record)) AS column_name FROM records
  WHERE json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record END) = 'OBJECT')
, typed AS (
  SELECT record_no, column_name, CASE json_type(record, '$.' || column_name) WHEN 'UBIGINT' THEN 'bigint' WHEN 'BIGINT' THEN 'bigint'
    WHEN 'DOUBLE' THEN 'decimal' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'void'
    ELSE lower(json_type(record, '$.' || column_name)) END AS t FROM fields)
SELECT column_name, arg_max(t, record_no) AS type_name, CAST(count(*) AS BIGINT) AS seen,
       array_to_string(list_sort(list(DISTINCT t)), ',') AS types
FROM typed GROUP BY column_name"""


ORACLES: dict[str, str] = {
    "record_profile": _record_profile("ORDER BY record_no LIMIT 10"),
    "record_profile_all": _record_profile(""),
    "drop_account": _drop_account(),
    "quarantined_trips": _quarantined(),
    "scan_many_files": duckdb_views() + _RAW_SELECT,
    "store_after_loads": BASE + " SELECT * FROM clean",
    "store_months_replaced": BASE + " SELECT * FROM clean WHERE trip_id % 2 = 0",
    "hotspots_batch": _batch(),
    "hotspots_batch_wrap": _batch(90, wrap=True),
    "hotspots_lloyd": _hotspots(),
    "minute_stats_instants": _instants_base() + f"""
SELECT pulocationid, pickup_minute, CAST(count(*) AS BIGINT) AS n,
       round(sum(total_amount), {D}) AS sum_total, round(sum(tip_amount), {D}) AS sum_tip
FROM clean GROUP BY pulocationid, pickup_minute""",
    "assign_given_centers": f"""
WITH points AS ({duckdb_text(POINTS_FX)}), centres AS ({duckdb_text(CENTRES_FX)})
, near AS (
  SELECT p.long, p.lat, min_by(c, ((p.long - center_long) * (p.long - center_long) + (p.lat - center_lat) * (p.lat - center_lat), center_id)) AS c
  FROM (SELECT DISTINCT long, lat FROM points) p, centres c GROUP BY p.long, p.lat)
SELECT trip_id, c.center_id, round(c.center_long, {D}) AS center_long, round(c.center_lat, {D}) AS center_lat
FROM points JOIN near USING (long, lat)""",
    "nearest_clusters_users": f"""
WITH users AS ({duckdb_text(GLOBE_USERS_FX)}), centres AS ({duckdb_text(GLOBE_CENTRES_FX)})
, near AS (
  SELECT user_id, center_id, {_hav('lat', 'long', 'center_lat', 'center_long').replace('sqrt(', 'sqrt(least(1.0, ', 1) + ')'} AS distance_mi
  FROM users, centres)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY distance_mi, center_id) AS INTEGER) AS rank,
       center_id, round(distance_mi, 4) AS distance_mi
FROM near QUALIFY rank <= 3""",
    "lloyd_overlapping": _lloyd(),
    "hotspots_instants": _instants_base() + _window() + _clusters() + _hotspot_select(),
    # sources
    "scan_parquet": duckdb_views() + _RAW_SELECT,
    "normalize_columns": duckdb_views() + _RAW_SELECT,
    "union_all_months": duckdb_views() + _RAW_SELECT,
    "union_positional": duckdb_views() + _RAW_SELECT,
    "scan_curated": BASE + " SELECT * FROM clean",
    "load_roundtrip": BASE + """
SELECT trip_id, pickup_hour, pickup_minute, CAST(pickup_minute - 900 AS INTEGER) AS time_diff,
       total_amount FROM clean WHERE pickup_minute - 900 BETWEEN -30 AND 30""",
    "schema_profile": _profile(),
    "preview_limit": duckdb_views() + " SELECT * FROM trips ORDER BY trip_id LIMIT 5",
    "zones_csv": BASE + f"""
SELECT locationid, zone, borough, round(long, {D}) AS long, round(lat, {D}) AS lat, n_vertices
FROM zone_pts""",
    # projections, filters, scalar functions
    "drop_incomplete": duckdb_views() + _COMPLETE + " SELECT * FROM complete",
    "typed_trips": BASE + " SELECT * FROM clean",
    "pickup_dropoff_hour": BASE + " SELECT trip_id, pickup_hour, dropoff_hour FROM clean",
    "zones_project": BASE + """
SELECT TRY_CAST(locationid AS BIGINT) AS locationid_pu, zone AS zone_pu,
       the_geom AS geometry, borough AS borough_pu
FROM zones""",
    "zone_vertices": BASE + """
SELECT locationid, CAST(i - 1 AS INTEGER) AS vertex_no, vertices[i][1] AS x, vertices[i][2] AS y
FROM (SELECT locationid, vertices, generate_subscripts(vertices, 1) AS i
      FROM zone_v) q""",
    "zone_centroids": BASE + f"""
SELECT locationid, zone, borough, round(long, {D}) AS long, round(lat, {D}) AS lat, n_vertices
FROM zone_pts""",
    "time_window_trips": BASE + _window() + _WINDOW_SELECT,
    "time_window_midnight": BASE + _window("00:10:00") + _WINDOW_SELECT,
    "time_window_wrap": BASE + _window("23:45:00", wrap=True) + _WINDOW_SELECT,
    "borough_filter": BASE + _window(borough="asia") + _WINDOW_SELECT,
    "trips_left_join_zones": BASE + f"""
SELECT c.trip_id, c.pulocationid, z.zone, z.borough, round(z.long, {D}) AS long,
       round(z.lat, {D}) AS lat
FROM clean c LEFT JOIN zone_pts z ON c.pulocationid = z.locationid""",
    "trips_with_point": BASE + _window() + f"""
SELECT trip_id, pulocationid, round(long, {D}) AS long, round(lat, {D}) AS lat FROM pts""",
    "haversine_miles": BASE + f"""
SELECT c.trip_id, round({_hav('z.lat', 'z.long', repr(USER_LAT), repr(USER_LONG))}, {D}) AS distance_mi
FROM clean c JOIN zone_pts z ON c.pulocationid = z.locationid
WHERE z.long IS NOT NULL AND z.lat IS NOT NULL""",
    "sql_function_surface": BASE + f"""
SELECT c.trip_id, round({_hav('z.lat', 'z.long', repr(USER_LAT), repr(USER_LONG))}, {D}) AS distance_mi,
       z.n_vertices
FROM clean c JOIN zone_pts z ON c.pulocationid = z.locationid
WHERE z.long IS NOT NULL AND z.lat IS NOT NULL""",
    # aggregates and top-k
    "trips_per_hour": BASE + """
SELECT pickup_hour, CAST(count(*) AS BIGINT) AS num_trips FROM clean GROUP BY pickup_hour""",
    "trips_per_location": BASE + """
SELECT pulocationid, CAST(count(*) AS BIGINT) AS trip_nums FROM clean GROUP BY pulocationid""",
    "best_pickup_locations": BASE + """
SELECT pulocationid, CAST(count(pulocationid) AS BIGINT) AS count FROM clean
GROUP BY pulocationid ORDER BY count DESC, pulocationid ASC NULLS FIRST LIMIT 10""",
    "top_pickup_zones": BASE + """
SELECT z.zone, CAST(count(*) AS BIGINT) AS count
FROM clean c LEFT JOIN zone_pts z ON c.pulocationid = z.locationid
GROUP BY z.zone ORDER BY count DESC, z.zone ASC NULLS FIRST LIMIT 10""",
    "zone_minute_stats": BASE + f"""
SELECT pulocationid, pickup_minute, CAST(count(*) AS BIGINT) AS n,
       round(sum(total_amount), {D}) AS sum_total, round(sum(tip_amount), {D}) AS sum_tip
FROM clean GROUP BY pulocationid, pickup_minute""",
    # machine learning and the flagship
    "assemble_features": BASE + _window() + f"""
SELECT trip_id, round(long, {D}) AS x, round(lat, {D}) AS y FROM pts""",
    "kmeans_clusters": BASE + _window() + _clusters() + f"""
SELECT round(centroid_long, {D}) AS center_long, round(centroid_lat, {D}) AS center_lat, trips FROM cl""",
    "assign_nearest_center": BASE + _window() + f"""
, centres AS (SELECT borough, avg(long) AS center_long, avg(lat) AS center_lat FROM pts GROUP BY borough)
SELECT p.trip_id, round(c.center_long, {D}) AS center_long, round(c.center_lat, {D}) AS center_lat
FROM pts p JOIN centres c USING (borough)""",
    "cluster_avg": BASE + _window() + _clusters() + f"""
SELECT round(centroid_long, {D}) AS centroid_long, round(centroid_lat, {D}) AS centroid_lat,
       round(avg_revenue, {D}) AS avg_revenue, round(avg_tip, {D}) AS avg_tip, trips FROM cl""",
    "join_cluster_stats": BASE + _window() + _clusters() + f"""
SELECT round(centroid_long, {D}) AS centroid_long, round(centroid_lat, {D}) AS centroid_lat,
       round(avg_revenue, {D}) AS avg_revenue, round(avg_tip, {D}) AS avg_tip FROM cl""",
    "expected_price": BASE + _window() + _clusters() + f"""
SELECT round(centroid_long, {D}) AS centroid_long, round(centroid_lat, {D}) AS centroid_lat,
       CAST(floor(avg_revenue + avg_tip + 0.5) AS BIGINT) AS expected_price FROM cl""",
    "nearest_clusters": BASE + _window() + _clusters() + f"""
SELECT rank, round(centroid_long, {D}) AS centroid_long, round(centroid_lat, {D}) AS centroid_lat,
       round(distance_mi, {D}) AS distance_mi FROM top""",
    "hotspots": _hotspots(),
    "hotspots_borough": _hotspots(borough="asia"),
    "hotspots_morning": _hotspots("08:15:00"),
    "hotspots_midnight": _hotspots("00:10:00"),
    "hotspots_late_wrap": _hotspots("23:45:00", wrap=True),
    "hotspots_minute_stats": _hotspots(),
    "hotspots_trip_level": _hotspots(),
    "hotspots_reply": BASE + _window() + _clusters() + f"""
, h AS ({_hotspot_select()})
SELECT to_json(struct_pack(data := list([centroid_long::DECIMAL(20,6), centroid_lat::DECIMAL(20,6),
       avg_revenue::DECIMAL(20,6), avg_tip::DECIMAL(20,6)] ORDER BY rank)))::VARCHAR AS reply
FROM h""",
    "hotspots_json": BASE + _window() + _clusters() + f"""
, h AS ({_hotspot_select()})
SELECT rank, to_json(struct_pack(centroid_long := centroid_long::DECIMAL(20,6),
       centroid_lat := centroid_lat::DECIMAL(20,6), avg_revenue := avg_revenue::DECIMAL(20,6),
       avg_tip := avg_tip::DECIMAL(20,6), trips := trips,
       distance_mi := distance_mi::DECIMAL(20,6), expected_price := expected_price))::VARCHAR AS data
FROM h""",
}
