"""Named query plans over the fixture tables: ``name -> f(spark, sf_dir)``.

Trips come from ``events`` and zones from ``nation JOIN region`` (see
``farewise.fixtures``).  Computed doubles are rounded to 6 decimals so results
compare across engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

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
    raw_trips,
    raw_zones,
    stand_in,
)
from farewise.functions.geo import haversine_miles, register_sql_functions
from farewise.functions.price import expected_price
from farewise.operators.account import drop_account, quarantined
from farewise.operators.clean import clean_trips, drop_incomplete
from farewise.operators.kmeans import assemble_features, model_centres
from farewise.operators.enrich import attach_zones, filter_borough, with_point
from farewise.operators.explore import (
    best_pickup_locations,
    top_pickup_zones,
    trips_per_hour,
    trips_per_location,
)
from farewise.operators.lloyd import lloyd
from farewise.operators.nearest import assign_to_centres, nearest_hotspots
from farewise.operators.window import time_window
from farewise.plans.batch import hotspots_batch
from farewise.plans.hotspots import (
    cluster_stats,
    fit_and_assign,
    hotspots,
    hotspots_from_minute_stats,
    hotspots_json,
    hotspots_reply,
    nearest_clusters,
    windowed_trips,
    zone_minute_stats,
    zone_window_stats,
)
from farewise.session import scratch_path
from farewise.sources.profile import preview, record_profile, schema_profile
from farewise.sources.trips import (
    append_load,
    compact_store,
    load_trips,
    normalize_columns,
    positional_union,
    read_store,
    read_trip_files,
)
from farewise.sources.zones import read_zones_csv, zone_points, zone_vertices

DEFAULT_TIME = "15:00:00"
BOROUGH = "asia"
DIGITS = 6

WINDOW_COLUMNS = [
    "tpep_pickup_datetime", "tpep_dropoff_datetime", "time_diff", "trip_distance",
    "passenger_count", "pulocationid", "dolocationid", "zone", "long", "lat",
    "tip_amount", "total_amount",
]


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (summation order differs between engines)."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def floored(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double by one product, sum and quotient, which both engines do alike also
    where a value lies exactly between two results."""
    scale = F.lit(10.0**digits)
    return df.select(
        *[
            (F.floor(F.col(f.name) * scale + 0.5) / scale).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def trips(spark: SparkSession, sf: str) -> DataFrame:
    return clean_trips(raw_trips(spark, sf))


def zones(spark: SparkSession, sf: str) -> DataFrame:
    return zone_points(raw_zones(spark, sf))


def windowed_zone_trips(spark, sf, time=DEFAULT_TIME, borough=None, wrap=False):
    # window first, then cleaning (same rows; the completeness check runs on few rows)
    w = windowed_trips(raw_trips(spark, sf), time, wrap_midnight=wrap)
    return filter_borough(attach_zones(w, zones(spark, sf)), borough)


# --- sources -----------------------------------------------------------------


def q_scan_parquet(spark, sf):
    """Raw trips as scanned from the source table."""
    return raw_trips(spark, sf)


def q_normalize_columns(spark, sf):
    """Trips whose column case drifted, lower-cased back."""
    raw = raw_trips(spark, sf)
    shouted = raw.toDF(*[c.upper() if i % 2 else c.title() for i, c in enumerate(raw.columns)])
    return normalize_columns(shouted)


# Day-of-month bands standing in for monthly files.
MONTH_BANDS = ((1, 7), (8, 14), (15, 21), (22, 31))


def _month_frames(raw: DataFrame) -> list[DataFrame]:
    """The trips cut into four "months"; the 2nd and 4th carry upper-case
    names and a float passenger count, as monthly files drift."""
    day = F.coalesce(F.dayofmonth("tpep_pickup_datetime"), F.lit(1))
    frames = []
    for i, (lo, hi) in enumerate(MONTH_BANDS):
        f = raw.filter(day.between(lo, hi))
        if i % 2:
            f = f.withColumn("passenger_count", F.col("passenger_count").cast("float"))
            f = f.toDF(*[c.upper() for c in f.columns])
        frames.append(f)
    return frames


def q_union_all_months(spark, sf):
    """Monthly files with drifting column case, read back as one frame."""
    base = scratch_path(spark, "months")
    paths = []
    for i, f in enumerate(_month_frames(raw_trips(spark, sf))):
        paths.append(f"{base}/month={i + 1}")
        f.write.parquet(paths[-1])
    return read_trip_files(spark, paths)


def q_union_positional(spark, sf):
    """The month frames unioned by position: first frame's names, widened types."""
    return positional_union(_month_frames(raw_trips(spark, sf)))


def q_scan_curated(spark, sf):
    """Trips loaded into the curated store and read back."""
    target = load_trips(raw_trips(spark, sf), scratch_path(spark, "curated"))
    return read_store(spark, target)


def q_load_roundtrip(spark, sf):
    """Window query over the curated store: the hour predicate prunes
    partition folders, the minute predicate is pushed into the Parquet scan."""
    target = load_trips(raw_trips(spark, sf), scratch_path(spark, "curated"))
    return time_window(read_store(spark, target), DEFAULT_TIME).select(
        "trip_id", "pickup_hour", "pickup_minute", "time_diff", "total_amount"
    )


def q_schema_profile(spark, sf):
    """(column, type) seen on a 10-row sample of the raw trips."""
    return schema_profile(raw_trips(spark, sf), 10)


def q_preview_limit(spark, sf):
    """First 5 raw trips by id."""
    return preview(raw_trips(spark, sf), 5, ["trip_id"])


def q_zones_csv(spark, sf):
    """Zones written as a headered CSV and read back as strings."""
    path = scratch_path(spark, "zones-csv")
    raw_zones(spark, sf).write.option("header", True).csv(path)
    return rounded(zone_points(read_zones_csv(spark, path)))


# --- projections, filters, scalar functions ----------------------------------


def q_drop_incomplete(spark, sf):
    """Raw trips without any null/NaN column (F1)."""
    return drop_incomplete(raw_trips(spark, sf))


def q_typed_trips(spark, sf):
    """Cleaned trips: typed counts and distances, time parts."""
    return trips(spark, sf)


def q_pickup_dropoff_hour(spark, sf):
    """Pickup and drop-off hour per trip."""
    return trips(spark, sf).select("trip_id", "pickup_hour", "dropoff_hour")


def q_zones_project(spark, sf):
    """Zone table projected and renamed."""
    return raw_zones(spark, sf).selectExpr(
        "try_cast(locationid AS bigint) AS locationid_pu", "zone AS zone_pu",
        "the_geom AS geometry", "borough AS borough_pu",
    )


def q_zone_vertices(spark, sf):
    """Every WKT vertex of every zone."""
    v = zone_vertices(raw_zones(spark, sf))
    return v.select(
        "locationid", F.posexplode("vertices").alias("vertex_no", "xy")
    ).select("locationid", "vertex_no", F.get("xy", 0).alias("x"), F.get("xy", 1).alias("y"))


def q_zone_centroids(spark, sf):
    """Vertex-mean point of every zone."""
    return rounded(zones(spark, sf))


def q_time_window_trips(spark, sf):
    """The 12-column projection of trips within ±30 min of 15:00."""
    return rounded(windowed_zone_trips(spark, sf).select(*WINDOW_COLUMNS))


def q_time_window_midnight(spark, sf):
    """Window around 00:10 without wrapping midnight."""
    return rounded(windowed_zone_trips(spark, sf, "00:10:00").select(*WINDOW_COLUMNS))


def q_time_window_wrap(spark, sf):
    """Window around 23:45 wrapping midnight."""
    return rounded(windowed_zone_trips(spark, sf, "23:45:00", wrap=True).select(*WINDOW_COLUMNS))


def q_borough_filter(spark, sf):
    """Window trips in one borough, case-insensitive."""
    return rounded(windowed_zone_trips(spark, sf, borough=BOROUGH).select(*WINDOW_COLUMNS))


def q_trips_left_join_zones(spark, sf):
    """Every cleaned trip with its zone, null when it has none."""
    return rounded(
        attach_zones(trips(spark, sf), zones(spark, sf)).select(
            "trip_id", "pulocationid", "zone", "borough", "long", "lat"
        )
    )


def q_trips_with_point(spark, sf):
    """Window trips whose zone has a point."""
    return rounded(
        with_point(windowed_zone_trips(spark, sf)).select("trip_id", "pulocationid", "long", "lat")
    )


def q_haversine_miles(spark, sf):
    """Distance from each trip's zone point to the user."""
    t = with_point(attach_zones(trips(spark, sf), zones(spark, sf)))
    return rounded(
        t.select(
            "trip_id",
            haversine_miles("lat", "long", F.lit(USER_LAT), F.lit(USER_LONG)).alias("distance_mi"),
        )
    )


def q_sql_function_surface(spark, sf):
    """The same distance through the registered SQL functions."""
    register_sql_functions(spark)
    df = spark.sql(
        """
        SELECT t.trip_id,
               haversine_mi(get(c, 1), get(c, 0), {lat}, {long}) AS distance_mi,
               size(v) AS n_vertices
        FROM {trips} t
        JOIN (SELECT try_cast(locationid AS bigint) AS locationid,
                     wkt_vertices(the_geom) AS v,
                     vertex_center(wkt_vertices(the_geom)) AS c
              FROM {zones}) z
          ON t.pulocationid = z.locationid
        WHERE c IS NOT NULL
        """,
        trips=trips(spark, sf), zones=raw_zones(spark, sf), lat=USER_LAT, long=USER_LONG,
    )
    return rounded(df)


def q_expected_price(spark, sf):
    """Expected price of every cluster."""
    c = cluster_stats(_stats(spark, sf))
    return rounded(
        c.select("centroid_long", "centroid_lat",
                 expected_price("avg_revenue", "avg_tip").alias("expected_price"))
    )


# --- aggregates and top-k ----------------------------------------------------


def _instants(raw):
    """Trips whose times are the same instants whatever the session zone: local UTC times, counted from the epoch."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = lambda c: F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(c)))
    return raw.withColumns({c: instant(c) for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")})


def q_hotspots_instants(spark, sf):
    """Flagship over trips whose times are instants, local time of Kolkata."""
    return rounded(hotspots(_instants(raw_trips(spark, sf)), zones(spark, sf), DEFAULT_TIME, USER_LAT, USER_LONG, zone="Asia/Kolkata"))


def q_trips_per_hour(spark, sf):
    """Trips per pickup hour (A1)."""
    return trips_per_hour(trips(spark, sf))


def q_trips_per_location(spark, sf):
    """Trips per pickup location (A2)."""
    return trips_per_location(trips(spark, sf))


def q_best_pickup_locations(spark, sf):
    """Top 10 pickup locations by trips."""
    return best_pickup_locations(trips(spark, sf), 10)


def q_top_pickup_zones(spark, sf):
    """Top 10 zones by trips, the null zone included."""
    return top_pickup_zones(trips(spark, sf), zones(spark, sf), 10)


def q_zone_minute_stats(spark, sf):
    """Trips, revenue and tips per location and minute of day (§4.3)."""
    return rounded(zone_minute_stats(trips(spark, sf)))


# --- machine learning and the flagship ---------------------------------------


def _stats(spark, sf, time=DEFAULT_TIME, borough=None):
    # raw trips: the window is applied before the cleaning (same rows, less work)
    return zone_window_stats(raw_trips(spark, sf), zones(spark, sf), time, borough)


def q_assemble_features(spark, sf):
    """Feature vectors of the window trips, as two columns (M1)."""
    pts = assemble_features(windowed_zone_trips(spark, sf))
    arr = vector_to_array("features")
    return rounded(pts.select("trip_id", arr[0].alias("x"), arr[1].alias("y")))


def q_kmeans_clusters(spark, sf):
    """Fitted k-means centres with their trips (M2)."""
    assigned, model = fit_and_assign(_stats(spark, sf))
    if model is None:  # no trip in the window
        return spark.createDataFrame([], "center_long double, center_lat double, trips bigint")
    centres = model_centres(model, spark)
    used = assigned.groupBy("cluster").agg(F.sum("n").cast("bigint").alias("trips"))
    return rounded(centres.join(used, "cluster").drop("cluster"))


def q_assign_nearest_center(spark, sf):
    """Every trip of the window to its nearest centre (trip-level transform)."""
    _, model = fit_and_assign(_stats(spark, sf))
    if model is None:  # no trip in the window
        return spark.createDataFrame([], "trip_id bigint, center_long double, center_lat double")
    centres = model_centres(model, spark)
    pts = assemble_features(windowed_zone_trips(spark, sf))
    labelled = model.copy().setPredictionCol("cluster").transform(pts)
    out = labelled.join(F.broadcast(centres), "cluster")  # at most k rows
    return rounded(out.select("trip_id", "center_long", "center_lat"))


def q_cluster_avg(spark, sf):
    """Per-cluster member-mean centre, average revenue and tip."""
    return rounded(cluster_stats(_stats(spark, sf)))


def q_join_cluster_stats(spark, sf):
    """The same statistics as three aggregates joined on the cluster."""
    return rounded(cluster_stats(_stats(spark, sf), joined=True))


def q_nearest_clusters(spark, sf):
    """The 3 clusters nearest to the user."""
    near = nearest_clusters(cluster_stats(_stats(spark, sf)), USER_LAT, USER_LONG, 3)
    return rounded(near.select("rank", "centroid_long", "centroid_lat", "distance_mi"))


def _hotspots(spark, sf, time=DEFAULT_TIME, borough=None, wrap=False):
    return hotspots(
        raw_trips(spark, sf), zones(spark, sf), time, USER_LAT, USER_LONG, borough,
        wrap_midnight=wrap,
    )


def q_hotspots(spark, sf):
    """Flagship: the 3 hotspots nearest to the user at 15:00 (M4)."""
    return rounded(_hotspots(spark, sf))


def q_hotspots_borough(spark, sf):
    """Flagship restricted to one borough."""
    return rounded(_hotspots(spark, sf, borough=BOROUGH))


def q_hotspots_morning(spark, sf):
    """Flagship at 08:15."""
    return rounded(_hotspots(spark, sf, "08:15"))  # HH:MM, as the request form sends it


def q_hotspots_midnight(spark, sf):
    """Flagship at 00:10 (no midnight wrap)."""
    return rounded(_hotspots(spark, sf, "00:10:00"))


def q_hotspots_late_wrap(spark, sf):
    """Flagship at 23:45 with the window wrapping midnight."""
    return rounded(_hotspots(spark, sf, "23:45:00", wrap=True))


def q_hotspots_trip_level(spark, sf):
    """The flagship with k-means fitted on every trip of the window."""
    return rounded(
        hotspots(raw_trips(spark, sf), zones(spark, sf), DEFAULT_TIME, USER_LAT, USER_LONG,
                 fit_on="trips")
    )


def q_hotspots_json(spark, sf):
    """Flagship rows as JSON records."""
    return hotspots_json(rounded(_hotspots(spark, sf)))


def q_hotspots_reply(spark, sf):
    """Flagship as one JSON reply document."""
    return hotspots_reply(rounded(_hotspots(spark, sf)))


def q_hotspots_minute_stats(spark, sf):
    """The flagship answered from the landed per-zone, per-minute table."""
    path = scratch_path(spark, "zone-minute-stats")
    zone_minute_stats(trips(spark, sf)).write.parquet(path)
    stats = spark.read.parquet(path)
    return rounded(
        hotspots_from_minute_stats(stats, zones(spark, sf), DEFAULT_TIME, USER_LAT, USER_LONG)
    )


# --- tables of requests, centres and starting points ---------------------------


def _minute_stats(spark, sf):
    path = scratch_path(spark, "zone-minute-stats")
    zone_minute_stats(trips(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


def q_hotspots_batch(spark, sf):
    """The flagship for every request of a table: time, position, maybe a borough (M4)."""
    requests = stand_in(spark, sf, REQUESTS_FX)
    return floored(hotspots_batch(requests, _minute_stats(spark, sf), zones(spark, sf)))


def q_hotspots_batch_wrap(spark, sf):
    """The same with windows of ±90 minutes that wrap midnight."""
    requests = stand_in(spark, sf, REQUESTS_FX)
    return floored(hotspots_batch(requests, _minute_stats(spark, sf), zones(spark, sf), window_minutes=90, wrap_midnight=True))


def q_hotspots_lloyd(spark, sf):
    """Flagship with the zone points fitted by Lloyd's iterations (M2, M4)."""
    return rounded(hotspots(raw_trips(spark, sf), zones(spark, sf), DEFAULT_TIME, USER_LAT, USER_LONG, fit="lloyd"))


def q_minute_stats_instants(spark, sf):
    """Minute statistics of instants under a named zone (§4.3, E1)."""
    return rounded(zone_minute_stats(_instants(raw_trips(spark, sf)), zone="Asia/Kolkata"))


def q_assign_given_centers(spark, sf):
    """Every point to the nearest of a given table of centres."""
    points, centres = stand_in(spark, sf, POINTS_FX), stand_in(spark, sf, CENTRES_FX)
    return rounded(assign_to_centres(points, centres).select("trip_id", "center_id", "center_long", "center_lat"))


def q_nearest_clusters_users(spark, sf):
    """The 3 clusters nearest to every user, anywhere on the globe."""
    near = nearest_hotspots(stand_in(spark, sf, GLOBE_USERS_FX), stand_in(spark, sf, GLOBE_CENTRES_FX), 3)
    return rounded(near.select("user_id", "rank", "center_id", "distance_mi"), 4)


def q_lloyd_overlapping(spark, sf):
    """Weighted k-means on points without gaps, from stated starting centres (M2)."""
    return rounded(lloyd(stand_in(spark, sf, OVERLAP_FX), stand_in(spark, sf, STARTS_FX)))


# --- profiles, accounts, the store over time -------------------------------------


def q_record_profile(spark, sf):
    """Last seen type per field of the first ten schemaless records."""
    return record_profile(stand_in(spark, sf, RECORDS_FX))


def q_record_profile_all(spark, sf):
    """The same over all records: drifting fields with all their types."""
    return record_profile(stand_in(spark, sf, RECORDS_FX), sample_rows=None)


def q_drop_account(spark, sf):
    """Rows that cleaning drops, by failing column and in all (F1)."""
    return drop_account(raw_trips(spark, sf))


def q_quarantined_trips(spark, sf):
    """The rows that cleaning drops, with the columns that failed (F1)."""
    return quarantined(raw_trips(spark, sf)).select("trip_id", "pulocationid", F.array_join("failing", ",").alias("failing"))


def q_scan_many_files(spark, sf):
    """Daily files of every pickup location's share, their schema drifting, read as one frame."""
    base = scratch_path(spark, "days")
    raw = raw_trips(spark, sf).withColumn("_part", F.pmod(F.col("trip_id"), F.lit(40)))
    late = raw.withColumn("passenger_count", F.col("passenger_count").cast("float"))
    raw.filter("_part < 20").write.partitionBy("_part").parquet(f"{base}/a")
    late.filter("_part >= 20").toDF(*[c if c == "_part" else c.upper() for c in late.columns]).write.partitionBy("_part").parquet(f"{base}/b")
    some = [r["_part"] for r in raw.select("_part").distinct().collect()]  # at most 40 folders
    return read_trip_files(spark, [f"{base}/{'a' if p < 20 else 'b'}/_part={p}" for p in sorted(some)])


def q_store_after_loads(spark, sf):
    """A full load, batches added, months replaced and small loads merged: the store as last published."""
    raw, day = raw_trips(spark, sf), F.coalesce(F.dayofmonth("tpep_pickup_datetime"), F.lit(1))
    target = load_trips(raw.filter(day <= 10), scratch_path(spark, "store"))
    append_load(raw.filter(day.between(11, 20)), target, "batch-1")
    append_load(raw.filter(day > 20), target, "batch-2")
    append_load(raw.filter(day > 20), target, "batch-2")  # run again: not loaded twice
    compact_store(spark, target)
    return read_store(spark, target)


def q_store_months_replaced(spark, sf):
    """Every month of the store loaded again with the even trips only."""
    target = load_trips(raw_trips(spark, sf), scratch_path(spark, "store"))
    return read_store(spark, load_trips(raw_trips(spark, sf).filter("trip_id % 2 = 0"), target, mode="months"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_")
}
