"""Flagship query: the pickup hotspots nearest to a position at a time of day.

Plan (the only distributed work is one scan and two small shuffles):

1. trips in the ±window (over raw trips the window predicate runs before the
   cleaning), reduced to one row per pickup location.  Partial aggregation runs
   before the shuffle, so the exchange carries at most (tasks × locations) rows
   however skewed the locations are.
2. those rows joined to the zone points (optional borough filter; zones without
   a point dropped) and summed per point; Spark picks the join by byte size.
3. the weighted zone points are checkpointed to reliable storage (the only pass
   over trips) and laid out by a hash of the point on ``FIT_PARTITIONS`` sorted
   partitions, the same at every size and for every upstream layout: k-means
   iterates over at most #zones rows, deterministically, and never re-reads trips.
4. weighted k-means (weight = trips at the point) has the same objective as
   k-means over the trips themselves.
5. per-cluster member means, haversine distance to the user, top ``top_n``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewise.functions.geo import haversine_miles
from farewise.functions.price import expected_price
from farewise.operators.kmeans import (
    DEFAULT_K,
    DEFAULT_SEED,
    assemble_features,
    assign_clusters,
    cluster_aggregates,
    fit_kmeans,
    joined_cluster_stats,
)
from farewise.operators.enrich import filter_borough, with_point
from farewise.operators.joins import join_dimension
from farewise.operators.lloyd import lloyd_groups
from farewise.operators.clean import SOURCE_ZONE, clean_trips, is_clean, to_wall_clock
from farewise.operators.window import time_window
from farewise.sources.trips import normalize_columns
from farewise.session import cut_lineage

HOTSPOT_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.IntegerType(), nullable=False),
        T.StructField("centroid_long", T.DoubleType()),
        T.StructField("centroid_lat", T.DoubleType()),
        T.StructField("avg_revenue", T.DoubleType()),
        T.StructField("avg_tip", T.DoubleType()),
        T.StructField("trips", T.LongType()),
        T.StructField("distance_mi", T.DoubleType()),
        T.StructField("expected_price", T.LongType()),
    ]
)

CLUSTER_COLUMNS = ("centroid_long", "centroid_lat", "avg_revenue", "avg_tip", "trips")

# Partitions the zone points are fitted on.  Part of the answer's definition: the
# order in which k-means sees points is that of this layout.
FIT_PARTITIONS = 4


def windowed_trips(
    trips: DataFrame, time: str, window_minutes: int = 30, wrap_midnight: bool = False,
    raw: bool | None = None, zone: str = SOURCE_ZONE,
) -> DataFrame:
    """Cleaned trips in the time-of-day window.  Uncleaned trips (recognised by
    the missing ``pickup_minute``; ``raw`` overrides) are cleaned here: the cheap,
    selective window predicate is applied first and the cleaning (all-column
    null/NaN check, casts) only to the rows inside the window.  The filters
    commute, so the rows are the same either way."""
    if raw if raw is not None else not is_clean(trips):
        local = to_wall_clock(normalize_columns(trips), zone)
        return clean_trips(time_window(local, time, window_minutes, wrap_midnight))
    return time_window(trips, time, window_minutes, wrap_midnight)


def zone_window_stats(
    trips: DataFrame,
    zone_pts: DataFrame,
    time: str,
    borough: str | None = None,
    window_minutes: int = 30,
    wrap_midnight: bool = False,
    raw: bool | None = None,
    zone: str = SOURCE_ZONE,
) -> DataFrame:
    """Weighted zone points of the trips in the window:
    ``long, lat, n, sum_total, sum_tip``.  ``raw``: see ``windowed_trips``."""
    windowed = windowed_trips(trips, time, window_minutes, wrap_midnight, raw, zone)
    per_loc = windowed.groupBy("pulocationid").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_amount").alias("sum_total"),
        F.sum("tip_amount").alias("sum_tip"),
    )
    return weighted_points(per_loc, zone_pts, borough)


def _points(zone_pts: DataFrame, borough: str | None) -> DataFrame:
    return with_point(filter_borough(zone_pts.select("locationid", "borough", "long", "lat"), borough))


def weighted_points(
    per_loc: DataFrame, zone_pts: DataFrame, borough: str | None = None
) -> DataFrame:
    """Per-location sums joined to zone points and summed per point."""
    joined = join_dimension(per_loc, _points(zone_pts, borough), "pulocationid", "locationid", "inner")
    return joined.groupBy("long", "lat").agg(
        F.sum("n").alias("n"),
        F.sum("sum_total").alias("sum_total"),
        F.sum("sum_tip").alias("sum_tip"),
    )


def prepare_points(stats: DataFrame, fit_partitions: int = FIT_PARTITIONS) -> DataFrame:
    """Zone points ready for fitting.

    The aggregate is materialised once to the checkpoint folder (the only pass
    over trips), then laid out by point on ``fit_partitions`` sorted partitions,
    so the fit does not depend on the upstream partitioning or on the size."""
    laid_out = cut_lineage(stats).repartition(fit_partitions, "long", "lat").sortWithinPartitions("long", "lat")
    return assemble_features(laid_out.withColumn("w", F.col("n").cast("double")))


def fit_and_assign(
    stats: DataFrame, k: int = DEFAULT_K, seed: int = DEFAULT_SEED, fit_partitions: int = FIT_PARTITIONS
) -> tuple[DataFrame, object] | tuple[None, None]:
    """Fit weighted k-means on zone points; return (points with ``cluster``,
    model), or (None, None) when there is no point."""
    points = prepare_points(stats, fit_partitions)
    if points.isEmpty():
        return None, None
    model = fit_kmeans(points, k=k, seed=seed, weight_col="w")
    return assign_clusters(points, model), model


def _empty(stats: DataFrame, schema: T.StructType) -> DataFrame:
    return stats.sparkSession.createDataFrame([], schema)


CLUSTER_SCHEMA = T.StructType(
    [
        T.StructField("centroid_long", T.DoubleType()),
        T.StructField("centroid_lat", T.DoubleType()),
        T.StructField("avg_revenue", T.DoubleType()),
        T.StructField("avg_tip", T.DoubleType()),
        T.StructField("trips", T.LongType()),
    ]
)


def cluster_stats(
    stats: DataFrame, k: int = DEFAULT_K, seed: int = DEFAULT_SEED, joined: bool = False, fit: str = "kmeans"
) -> DataFrame:
    """Per-cluster centre and statistics (no label).  ``joined`` computes them
    as three aggregates joined on the cluster key instead of one aggregate;
    ``fit``: see ``hotspots``."""
    if fit == "lloyd":
        # one group of at most as many points as there are zones
        return lloyd_groups(cut_lineage(stats.withColumn("_all", F.lit(0))), ["_all"], k).select(*CLUSTER_COLUMNS)
    if fit != "kmeans":
        raise ValueError(f"fit must be 'kmeans' or 'lloyd', got {fit!r}")
    assigned, _ = fit_and_assign(stats, k, seed)
    if assigned is None:
        return _empty(stats, CLUSTER_SCHEMA)
    if joined:
        return joined_cluster_stats(assigned).drop("cluster")
    return cluster_aggregates(assigned).select(*CLUSTER_COLUMNS)


def nearest_clusters(clusters: DataFrame, lat: float, long: float, top_n: int = 3) -> DataFrame:
    """The ``top_n`` clusters nearest to (lat, long), with ``distance_mi`` and
    ``rank`` (ties broken by centre)."""
    order = [F.col("distance_mi"), F.col("centroid_long"), F.col("centroid_lat")]
    with_distance = clusters.withColumn(
        "distance_mi",
        haversine_miles("centroid_lat", "centroid_long", F.lit(float(lat)), F.lit(float(long))),
    )
    top = with_distance.orderBy(*order).limit(top_n)
    # At most top_n rows reach this window.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hotspots(
    trips: DataFrame,
    zone_pts: DataFrame,
    time: str,
    lat: float,
    long: float,
    borough: str | None = None,
    *,
    k: int = DEFAULT_K,
    seed: int = DEFAULT_SEED,
    window_minutes: int = 30,
    top_n: int = 3,
    wrap_midnight: bool = False,
    fit_on: str = "zones",
    fit: str = "kmeans",
    raw: bool | None = None,
    zone: str = SOURCE_ZONE,
) -> DataFrame:
    """Hotspots near (lat, long) at ``time``: rows of ``HOTSPOT_SCHEMA``.

    ``trips`` are cleaned trips (``clean_trips`` or the curated store) or
    uncleaned ones, which are recognised and cleaned inside the window;
    ``zone`` is that of times delivered as instants; ``zone_pts`` come from
    ``zone_points``.
    No trip in the window gives an empty result with the same schema.

    ``fit_on="zones"`` (default) fits weighted k-means on the zone points of
    the window (one pass over trips).  ``fit_on="trips"`` fits on every trip
    of the window, as the original program does: same objective, but k-means‖
    draws its initial centres from trips rather than from distinct points,
    so on data without clear clusters it may settle in another local optimum.
    It costs a pass over the windowed trips per k-means step.

    ``fit="lloyd"`` fits the zone points by ``lloyd_groups`` instead of ``pyspark.ml``:
    the answer of ``hotspots_batch``, also where clusters overlap."""
    if fit_on == "trips":
        if fit != "kmeans":
            raise ValueError("trips are fitted by kmeans only")
        clusters = trip_level_cluster_stats(
            trips, zone_pts, time, borough, window_minutes, wrap_midnight, k, seed, raw, zone,
        )
        return _hotspot_rows(clusters, lat, long, top_n)
    if fit_on != "zones":
        raise ValueError(f"fit_on must be 'zones' or 'trips', got {fit_on!r}")
    stats = zone_window_stats(
        trips, zone_pts, time, borough, window_minutes, wrap_midnight, raw, zone
    )
    return hotspots_from_points(stats, lat, long, k=k, seed=seed, top_n=top_n, fit=fit)


def trip_level_cluster_stats(
    trips: DataFrame,
    zone_pts: DataFrame,
    time: str,
    borough: str | None = None,
    window_minutes: int = 30,
    wrap_midnight: bool = False,
    k: int = DEFAULT_K,
    seed: int = DEFAULT_SEED,
    raw: bool | None = None,
    zone: str = SOURCE_ZONE,
    salt_buckets: int | None = None,
) -> DataFrame:
    """Cluster statistics from k-means fitted on every trip of the window.

    The windowed trips with their points are persisted for the iterations and
    released once the (at most ``k``-row) cluster table is checkpointed.  That
    is about 4% of the trip table for ±30 minutes: at 100 TB use the zone-level
    default, which carries one row per zone."""
    windowed = windowed_trips(trips, time, window_minutes, wrap_midnight, raw, zone)
    pts = _points(zone_pts, borough)
    joined = join_dimension(windowed, pts, "pulocationid", "locationid", "inner", salt_buckets)
    points = assemble_features(joined.select("long", "lat", "total_amount", "tip_amount"))
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if points.isEmpty():
            return _empty(trips, CLUSTER_SCHEMA)
        model = fit_kmeans(points, k=k, seed=seed)
        per_cluster = assign_clusters(points, model).groupBy("cluster").agg(
            F.avg("long").alias("centroid_long"),
            F.avg("lat").alias("centroid_lat"),
            F.avg("total_amount").alias("avg_revenue"),
            F.avg("tip_amount").alias("avg_tip"),
            F.count(F.lit(1)).alias("trips"),
        )
        return cut_lineage(per_cluster.select(*CLUSTER_COLUMNS))
    finally:
        points.unpersist()


def hotspots_from_points(
    stats: DataFrame, lat: float, long: float, *, k: int = DEFAULT_K,
    seed: int = DEFAULT_SEED, top_n: int = 3, fit: str = "kmeans",
) -> DataFrame:
    return _hotspot_rows(cluster_stats(stats, k, seed, fit=fit), lat, long, top_n)


def _hotspot_rows(clusters: DataFrame, lat: float, long: float, top_n: int) -> DataFrame:
    near = nearest_clusters(clusters, lat, long, top_n)
    return near.select(
        F.col("rank").cast("int").alias("rank"),
        "centroid_long",
        "centroid_lat",
        "avg_revenue",
        "avg_tip",
        "trips",
        "distance_mi",
        expected_price("avg_revenue", "avg_tip").alias("expected_price"),
    )


def hotspots_json(result: DataFrame) -> DataFrame:
    """One JSON record per hotspot: ``rank, data``.  Doubles are written as
    fixed-point numbers with 6 decimals (0.1 m in degrees, a millionth of a
    dollar), never in exponent notation."""
    fields = [
        F.col(f.name).cast("decimal(20,6)").alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in result.schema.fields if f.name != "rank"
    ]
    return result.select("rank", F.to_json(F.struct(*fields)).alias("data"))


def hotspots_reply(result: DataFrame) -> DataFrame:
    """The whole answer as one JSON document, in the shape the original
    service replies with: ``{"data": [[long, lat, avg revenue, avg tip], ...]}``
    in rank order (``reply`` column, one row; ``{"data":[]}`` when empty).
    Only the at most ``top_n`` result rows are gathered into that row."""
    values = [F.col(c).cast("decimal(20,6)") for c in ("centroid_long", "centroid_lat", "avg_revenue", "avg_tip")]
    ranked = F.struct(F.col("rank"), F.array(*values).alias("v"))
    return result.agg(F.sort_array(F.collect_list(ranked)).alias("l")).select(
        F.to_json(F.struct(F.col("l.v").alias("data"))).alias("reply")
    )


# ---------------------------------------------------------------------------
# Many requests: land the additive per-zone, per-minute statistics once.


def zone_minute_stats(trips: DataFrame, zone: str = SOURCE_ZONE) -> DataFrame:
    """``pulocationid, pickup_minute, n, sum_total, sum_tip``.

    Bounded by locations × 1440 rows and additive, so any window is a filter
    and a re-sum of it; the trip scan happens once for all requests.  Uncleaned
    trips are cleaned first; ``zone`` is that of times delivered as instants."""
    if not is_clean(trips):
        trips = clean_trips(normalize_columns(trips), zone)
    return trips.groupBy("pulocationid", "pickup_minute").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_amount").alias("sum_total"),
        F.sum("tip_amount").alias("sum_tip"),
    )


def add_minute_stats(landed: DataFrame, new_trips: DataFrame, zone: str = SOURCE_ZONE) -> DataFrame:
    """Fold a new batch of cleaned trips (a newly loaded month) into landed
    ``zone_minute_stats``: the statistics are additive, so history is not
    re-read.  The caller writes the result to a new location and switches."""
    keys = ["pulocationid", "pickup_minute"]
    both = landed.select(*keys, "n", "sum_total", "sum_tip").unionByName(zone_minute_stats(new_trips, zone))
    return both.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sum_total").alias("sum_total"), F.sum("sum_tip").alias("sum_tip")
    )


def hotspots_from_minute_stats(
    minute_stats: DataFrame,
    zone_pts: DataFrame,
    time: str,
    lat: float,
    long: float,
    borough: str | None = None,
    *,
    k: int = DEFAULT_K,
    seed: int = DEFAULT_SEED,
    window_minutes: int = 30,
    top_n: int = 3,
    wrap_midnight: bool = False,
    fit: str = "kmeans",
) -> DataFrame:
    """Same answer as ``hotspots``, read from ``zone_minute_stats`` (made with the same ``zone``)."""
    windowed = time_window(minute_stats, time, window_minutes, wrap_midnight)
    per_loc = windowed.groupBy("pulocationid").agg(
        F.sum("n").alias("n"), F.sum("sum_total").alias("sum_total"), F.sum("sum_tip").alias("sum_tip")
    )
    stats = weighted_points(per_loc, zone_pts, borough)
    return hotspots_from_points(stats, lat, long, k=k, seed=seed, top_n=top_n, fit=fit)
