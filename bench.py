"""Benchmark the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Every query is evaluated completely (``noop`` sink: all rows produced, none
collected); each is run three times after a warm-up and the fastest run is kept.
``baseline`` holds the same flagship answered the way the original program
shapes it (k-means fitted on every trip of the window, three aggregates joined
on the cluster label), measured in the same session, for comparison.
``scaled_x10`` times the flagship both ways on the trips replicated ten times
inside Spark (``BENCH_SCALE_REP``; 1 skips it), where volume rather than job
overhead decides.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "hotspots",
    "hotspots_borough",
    "hotspots_minute_stats",
    "time_window_trips",
    "trips_per_hour",
    "trips_per_location",
    "best_pickup_locations",
    "top_pickup_zones",
    "trips_left_join_zones",
    "zone_minute_stats",
    "scan_curated",
    "hotspots_batch",
    "assign_given_centers",
    "nearest_clusters_users",
]


def trip_level_hotspots(spark, sf):
    """The flagship shaped as the original program computes it, on the fixture tables."""
    from farewise.plans import catalog as cat

    # raw trips, windowed before cleaning, like the flagship it is held against
    return trip_level_hotspots_from(cat.raw_trips(spark, sf), cat.zones(spark, sf))


def trip_level_hotspots_from(trips, zones):
    """k-means fitted on every trip of the window (not on zone points), then
    three aggregates joined on the cluster label; same native expressions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.sql import functions as F

    from farewise.fixtures import USER_LAT, USER_LONG
    from farewise.functions.geo import haversine_miles
    from farewise.operators.kmeans import assemble_features
    from farewise.operators.enrich import attach_zones
    from farewise.plans.hotspots import windowed_trips

    w = attach_zones(windowed_trips(trips, "15:00:00"), zones)
    pts = assemble_features(w)
    model = KMeans(k=5, seed=42).fit(pts.select("features"))
    t = model.transform(pts)
    rev = t.groupBy("prediction").agg(F.avg("total_amount").alias("avg_revenue"))
    tip = t.groupBy("prediction").agg(F.avg("tip_amount").alias("avg_tip"))
    cen = t.groupBy("prediction").agg(F.avg("long").alias("centroid_long"), F.avg("lat").alias("centroid_lat"))
    c = cen.join(rev, "prediction", "left").join(tip, "prediction", "left")
    return (
        c.withColumn("distance_mi", haversine_miles("centroid_lat", "centroid_long",
                                                    F.lit(USER_LAT), F.lit(USER_LONG)))
        .orderBy("distance_mi").limit(3)
    )


def replicated_events(spark, sf, rep):
    """The sf ``events`` table replicated ``rep`` times inside Spark (ids kept
    unique), landed under the checkpoint folder."""
    from pyspark.sql import functions as F

    from farewise.fixtures import read_table
    from farewise.session import scratch_path

    ev = read_table(spark, sf, "events")
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rep - 1).cast("bigint")))
    big = (ev.withColumn("copy", copy)
           .withColumn("event_id", F.col("event_id") + F.col("copy") * F.lit(10**9).cast("bigint"))
           .drop("copy"))
    path = scratch_path(spark, f"events-x{rep}")
    big.write.parquet(path)
    return spark.read.parquet(path)


def scaled_flagship(spark, sf, rep, timed):
    """The flagship three ways on ``rep`` × the trips: zone-level over raw
    trips, zone-level over the curated store, trip-level shape."""
    from farewise.fixtures import TRIPS_FX, USER_LAT, USER_LONG
    from farewise.plans import catalog as cat
    from farewise.plans.hotspots import hotspots
    from farewise.session import scratch_path
    from farewise.sources.trips import load_trips, read_store

    raw = spark.sql(TRIPS_FX, events=replicated_events(spark, sf, rep))
    zones = cat.zones(spark, sf)
    curated = load_trips(raw, scratch_path(spark, f"curated-x{rep}"))
    return {
        "hotspots": timed(lambda sp, _: hotspots(raw, zones, "15:00:00", USER_LAT, USER_LONG),
                          f"x{rep}.hotspots"),
        "hotspots_curated": timed(
            lambda sp, _: hotspots(read_store(sp, curated), zones, "15:00:00", USER_LAT, USER_LONG),
            f"x{rep}.hotspots_curated",
        ),
        "hotspots_trip_level": timed(lambda sp, _: trip_level_hotspots_from(raw, zones),
                                     f"x{rep}.hotspots_trip_level"),
    }


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("farewise-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(max(2 * cpus, 8)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from farewise.session import checkpoint_dir

    if checkpoint_dir(spark) is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="farewise-bench-"))

    from farewise.plans.catalog import QUERIES

    _run(QUERIES["trips_per_hour"](spark, sf_dir))  # warm-up
    _run(QUERIES["hotspots"](spark, sf_dir))

    errors = {}

    def timed(make, name=None):
        best = None
        try:
            for _ in range(3):
                t0 = time.perf_counter()
                _run(make(spark, sf_dir))
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
        except Exception as ex:  # noqa: BLE001 - report, keep benchmarking the rest
            errors[name or getattr(make, "__name__", "query")] = f"{type(ex).__name__}: {str(ex)[:200]}"
            return None
        return round(best, 3)

    results = {name: timed(QUERIES[name], name) for name in HEADLINE}

    # Production path: land the curated store once, then answer from it
    # (hour folders pruned, minute ranges pushed into the Parquet scan).
    from farewise.fixtures import USER_LAT, USER_LONG, raw_trips
    from farewise.plans import catalog as cat
    from farewise.operators.explore import top_pickup_zones, trips_per_hour
    from farewise.plans.hotspots import hotspots, hotspots_from_minute_stats, zone_minute_stats
    from farewise.session import scratch_path
    from farewise.sources.trips import load_trips, read_store

    loads = []
    for _ in range(3):
        t0 = time.perf_counter()
        curated = load_trips(raw_trips(spark, sf_dir), scratch_path(spark, "bench-curated"))
        loads.append(time.perf_counter() - t0)
    results["load_trips"] = round(min(loads), 3)
    # counts over the curated store, and the minute statistics landed apart from the answer
    stats = scratch_path(spark, "bench-minute-stats")
    t0 = time.perf_counter()
    zone_minute_stats(read_store(spark, curated)).write.parquet(stats)
    results["minute_stats_landing"] = round(time.perf_counter() - t0, 3)
    results["minute_stats_answer"] = timed(
        lambda sp, sf: hotspots_from_minute_stats(sp.read.parquet(stats), cat.zones(sp, sf), "15:00:00", USER_LAT, USER_LONG),
        "minute_stats_answer",
    )
    results["trips_per_hour_curated"] = timed(lambda sp, sf: trips_per_hour(read_store(sp, curated)), "trips_per_hour_curated")
    results["top_pickup_zones_curated"] = timed(
        lambda sp, sf: top_pickup_zones(read_store(sp, curated), cat.zones(sp, sf)), "top_pickup_zones_curated"
    )
    results["hotspots_curated"] = timed(
        lambda sp, sf: cat.rounded(hotspots(read_store(sp, curated), cat.zones(sp, sf),
                                            "15:00:00", USER_LAT, USER_LONG)),
        "hotspots_curated",
    )
    baseline = {"hotspots_trip_level": timed(trip_level_hotspots, "hotspots_trip_level")}
    rep = int(os.environ.get("BENCH_SCALE_REP", "10"))
    scaled = {}
    if rep > 1:
        try:
            scaled = scaled_flagship(spark, sf_dir, rep, timed)
        except Exception as ex:  # noqa: BLE001
            errors[f"scaled_x{rep}"] = f"{type(ex).__name__}: {str(ex)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(v for v in results.values() if v is not None), 3),
                "unit": "sec",
                "queries": results,
                "baseline": baseline,
                f"scaled_x{rep}": scaled,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                **({"errors": errors} if errors else {}),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
