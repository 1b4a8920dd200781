"""Flagship query: edge cases (empty window, fewer points than k), equality
with trip-level statistics, determinism, and the shape of the physical plan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from farewise.fixtures import USER_LAT, USER_LONG
from farewise.operators.clean import clean_trips
from farewise.operators.enrich import attach_zones, with_point
from farewise.operators.window import time_window
from farewise.plans import catalog as cat
from farewise.plans.explain import plan_text
from farewise.plans.hotspots import (
    HOTSPOT_SCHEMA,
    cluster_stats,
    hotspots,
    zone_window_stats,
)
from farewise.sources.zones import zone_points

from conftest import SF_CHECK, SF_SMALL

TRIP_SCHEMA = (
    "trip_id bigint, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
    "passenger_count double, trip_distance double, pulocationid bigint, dolocationid bigint, "
    "tip_amount double, total_amount double"
)
ZONE_SCHEMA = "locationid string, zone string, borough string, the_geom string"


def _zones(spark, n):
    rows = []
    for i in range(n):
        x, y = -74.0 + 0.1 * i, 40.6 + 0.05 * i
        rows.append((str(i), f"Z{i}", "B", f"MULTIPOLYGON ((({x:.4f} {y:.4f}, {x + 0.001:.4f} {y:.4f})))"))
    return zone_points(spark.createDataFrame(rows, ZONE_SCHEMA))


def _trips(spark, locs, h=15, m=0):
    ts = dt.datetime(2024, 1, 2, h, m)
    rows = [(i, ts, ts, 1.0, 1.0, loc, 1, 1.0, 10.0 + i) for i, loc in enumerate(locs)]
    return clean_trips(spark.createDataFrame(rows, TRIP_SCHEMA))


def test_no_trip_in_window_gives_empty_result(spark):
    out = hotspots(_trips(spark, [0, 1], h=3), _zones(spark, 2), "15:00:00", 40.7, -73.9)
    assert out.schema == HOTSPOT_SCHEMA
    assert out.count() == 0


def test_fewer_points_than_k(spark):
    out = hotspots(_trips(spark, [0, 0, 1]), _zones(spark, 2), "15:00", 40.7, -73.9, k=5)
    rows = out.collect()
    assert len(rows) == 2
    assert sum(r["trips"] for r in rows) == 3
    assert [r["rank"] for r in rows] == [1, 2]


def test_cluster_stats_equal_trip_level_means(spark):
    trips = cat.trips(spark, SF_CHECK)
    zones = cat.zones(spark, SF_CHECK)
    stats = zone_window_stats(trips, zones, "15:00:00")
    clusters = cluster_stats(stats).collect()
    # every trip with a point is in exactly one cluster
    pts = with_point(attach_zones(time_window(trips, "15:00:00"), zones))
    assert sum(r["trips"] for r in clusters) == pts.count()
    # per borough (the fixture's blobs) the trip-level means equal the cluster's
    by_borough = {
        round(r["long"], 6): r
        for r in pts.groupBy("borough").agg(
            F.avg("long").alias("long"), F.avg("total_amount").alias("rev"),
            F.avg("tip_amount").alias("tip"), F.count("*").alias("n")).collect()
    }
    for c in clusters:
        b = by_borough[round(c["centroid_long"], 6)]
        assert c["trips"] == b["n"]
        assert c["avg_revenue"] == pytest.approx(b["rev"], abs=1e-9)
        assert c["avg_tip"] == pytest.approx(b["tip"], abs=1e-9)


def test_hotspots_deterministic(spark):
    a = [tuple(r) for r in cat.q_hotspots(spark, SF_SMALL).collect()]
    b = [tuple(r) for r in cat.q_hotspots(spark, SF_SMALL).collect()]
    assert a == b and len(a) == 3
    assert [r[0] for r in a] == [1, 2, 3]
    assert all(a[i][6] <= a[i + 1][6] for i in range(2))


def test_minute_stats_path_equals_direct(spark):
    direct = [tuple(r) for r in cat.q_hotspots(spark, SF_SMALL).collect()]
    landed = [tuple(r) for r in cat.q_hotspots_minute_stats(spark, SF_SMALL).collect()]
    assert direct == landed


def test_distance_uses_user_lat_long_order(spark):
    rows = cat.q_hotspots(spark, SF_SMALL).collect()
    # the fixture blobs are within ~20 miles of the user, not thousands
    assert all(r["distance_mi"] < 50 for r in rows)
    assert USER_LAT > 0 > USER_LONG


# --- plan shape ----------------------------------------------------------------


def test_window_stats_plan(spark):
    stats = zone_window_stats(cat.trips(spark, SF_SMALL), cat.zones(spark, SF_SMALL), "15:00:00")
    plan = plan_text(stats)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "BroadcastHashJoin" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]  # unused column pruned
    # partial aggregation before every exchange of trip rows
    assert plan.count("HashAggregate") >= 4


def test_top_k_plan(spark):
    from farewise.operators.explore import best_pickup_locations

    plan = plan_text(best_pickup_locations(cat.trips(spark, SF_SMALL)))
    assert "TakeOrderedAndProject" in plan


def test_curated_store_prunes_and_pushes(spark, tmp_dir):
    from farewise.sources.trips import load_trips, read_store

    path = load_trips(cat.raw_trips(spark, SF_SMALL), f"{tmp_dir}/curated")
    q = time_window(read_store(spark, path), "15:00:00").select("pulocationid")
    plan = plan_text(q)
    assert "PartitionFilters: [isnotnull(pickup_hour" in plan
    assert "GreaterThanOrEqual(pickup_minute,870)" in plan
    assert "ReadSchema: struct<pulocationid:bigint,pickup_minute:int>" in plan
    assert q.count() == time_window(cat.trips(spark, SF_SMALL), "15:00:00").count()


def test_result_does_not_depend_on_session_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        a = [tuple(r) for r in cat.q_hotspots(spark, SF_SMALL).collect()]
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        b = [tuple(r) for r in cat.q_hotspots(spark, SF_SMALL).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert a == b


def test_every_point_is_assigned_to_its_nearest_centre(spark):
    from farewise.plans.hotspots import fit_and_assign

    stats = zone_window_stats(cat.trips(spark, SF_CHECK), cat.zones(spark, SF_CHECK), "08:15:00")
    assigned, model = fit_and_assign(stats)
    centres = [tuple(c) for c in model.clusterCenters()]
    for r in assigned.select("long", "lat", "cluster").collect():
        d = [(r["long"] - cx) ** 2 + (r["lat"] - cy) ** 2 for cx, cy in centres]
        assert d[r["cluster"]] == pytest.approx(min(d), abs=1e-15)


def test_trip_level_fit_agrees_on_separable_data(spark):
    trips, zones = cat.trips(spark, SF_SMALL), cat.zones(spark, SF_SMALL)
    a = [tuple(round(v, 6) if isinstance(v, float) else v for v in r)
         for r in hotspots(trips, zones, "15:00", 40.70, -73.95).collect()]
    b = [tuple(round(v, 6) if isinstance(v, float) else v for v in r)
         for r in hotspots(trips, zones, "15:00", 40.70, -73.95, fit_on="trips").collect()]
    assert a == b
    empty = hotspots(trips, zones, "15:00", 40.70, -73.95, borough="nowhere", fit_on="trips")
    assert empty.count() == 0 and empty.schema == HOTSPOT_SCHEMA
    with pytest.raises(ValueError):
        hotspots(trips, zones, "15:00", 40.70, -73.95, fit_on="points")


def test_minute_stats_are_additive(spark, tmp_dir):
    from farewise.plans.hotspots import add_minute_stats, zone_minute_stats

    trips = cat.trips(spark, SF_SMALL)
    day = F.dayofmonth("tpep_pickup_datetime")
    path = f"{tmp_dir}/stats"
    zone_minute_stats(trips.filter(day <= 15)).write.parquet(path)
    merged = add_minute_stats(spark.read.parquet(path), trips.filter(day > 15))
    whole = zone_minute_stats(trips)

    def canon(df):
        return sorted((r[0], r[1], r[2], round(r[3], 6), round(r[4], 6))
                      for r in df.select("pulocationid", "pickup_minute", "n", "sum_total", "sum_tip").collect())

    assert canon(merged) == canon(whole)


def test_flagship_shuffles_only_sums_per_location_and_point(spark, tmp_dir):
    from farewise.sources.trips import load_trips, read_store

    path = load_trips(cat.raw_trips(spark, SF_SMALL), f"{tmp_dir}/curated")
    stats = zone_window_stats(read_store(spark, path), cat.zones(spark, SF_SMALL), "15:00:00")
    plan = plan_text(stats, "simple")
    # partial sums per location, then per point; trips are never shuffled
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Exchange hashpartitioning(pulocationid" in plan and "Exchange hashpartitioning(long" in plan
    assert "SortMergeJoin" not in plan


def test_raw_mode_equals_cleaned_input(spark):
    raw, zones = cat.raw_trips(spark, SF_CHECK), cat.zones(spark, SF_CHECK)
    for time, wrap in (("15:00:00", False), ("23:45:00", True), ("00:10", False)):
        a = zone_window_stats(cat.trips(spark, SF_CHECK), zones, time, wrap_midnight=wrap)
        b = zone_window_stats(raw, zones, time, wrap_midnight=wrap)

        def canon(df):
            return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())

        assert canon(a) == canon(b)
    # the window predicate is evaluated before the all-column completeness check
    plan = plan_text(zone_window_stats(raw, zones, "15:00:00"), "simple")
    cond = plan.split("Filter (")[1].split("\n")[0]
    assert cond.index("870") < cond.index("atleastnnonnulls")


def test_reply_document(spark):
    import json

    from farewise.plans.hotspots import hotspots_reply

    doc = json.loads(cat.q_hotspots_reply(spark, SF_SMALL).first()["reply"])
    rows = cat.q_hotspots(spark, SF_SMALL).orderBy("rank").collect()
    assert [[round(v, 6) for v in d] for d in doc["data"]] == [
        [r["centroid_long"], r["centroid_lat"], r["avg_revenue"], r["avg_tip"]] for r in rows
    ]
    empty = hotspots(_trips(spark, [0, 1], h=3), _zones(spark, 2), "15:00", 40.7, -73.9)
    assert json.loads(hotspots_reply(empty).first()["reply"]) == {"data": []}


def test_minute_stats_path_with_borough_and_wrap(spark):
    from farewise.plans.hotspots import hotspots_from_minute_stats, zone_minute_stats

    trips, zones = cat.trips(spark, SF_CHECK), cat.zones(spark, SF_CHECK)
    stats = zone_minute_stats(trips)
    for time, borough, wrap in (("15:00", "asia", False), ("23:45", None, True), ("00:10", "The Europe", False)):
        direct = cat.rounded(hotspots(trips, zones, time, 40.70, -73.95, borough, wrap_midnight=wrap))
        landed = cat.rounded(hotspots_from_minute_stats(stats, zones, time, 40.70, -73.95, borough,
                                                        wrap_midnight=wrap))
        assert [tuple(r) for r in direct.collect()] == [tuple(r) for r in landed.collect()], (time, borough)


def test_uncleaned_trips_are_recognised(spark):
    """Null amounts: the default answer is that over cleaned trips, not sum / count(*)."""
    raw = cat.raw_trips(spark, SF_CHECK)
    holed = raw.withColumn("total_amount", F.when(F.col("trip_id") % 3 != 0, F.col("total_amount")))
    zones = cat.zones(spark, SF_CHECK)
    default = hotspots(holed, zones, "15:00", 40.7, -73.95)
    cleaned = hotspots(clean_trips(holed), zones, "15:00", 40.7, -73.95)

    def canon(df):
        return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.orderBy("rank").collect()]

    assert canon(default) == canon(cleaned) and len(canon(default)) == 3


def test_instants_do_not_depend_on_the_session_zone(spark):
    zones = cat.zones(spark, SF_SMALL)
    old = spark.conf.get("spark.sql.session.timeZone")
    answers, hours = [], []
    try:
        for session in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session)
            answers.append([tuple(r) for r in cat.q_hotspots_instants(spark, SF_SMALL).orderBy("rank").collect()])
            raw = cat.raw_trips(spark, SF_SMALL).limit(50)
            epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            instants = raw.withColumn(
                "tpep_pickup_datetime",
                F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("tpep_pickup_datetime"))),
            )
            got = clean_trips(instants, "America/New_York").select("trip_id", "pickup_hour", "pickup_minute")
            hours.append(sorted(tuple(r) for r in got.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert answers[0] == answers[1] and hours[0] == hours[1]


def _spread_points(spark, n):
    """Weighted points without any clusters."""
    import random

    rnd = random.Random(7)
    rows = [(rnd.random(), rnd.random(), rnd.randint(1, 9), 1.0, 1.0) for _ in range(n)]
    return spark.createDataFrame(rows, "long double, lat double, n bigint, sum_total double, sum_tip double")


def test_clusters_do_not_depend_on_the_upstream_layout(spark):
    from farewise.plans.hotspots import fit_and_assign

    points = _spread_points(spark, 300)

    def centres(df):
        return [tuple(c) for c in fit_and_assign(df)[1].clusterCenters()]

    first = centres(points.repartition(1))
    assert centres(points.repartition(7)) == first
    assert centres(points.repartition(13, "lat").sortWithinPartitions("lat")) == first


def test_cost_is_near_an_independent_lloyd_run(spark):
    import numpy as np

    from farewise.plans.hotspots import fit_and_assign

    points = _spread_points(spark, 2000)
    rows = np.array([tuple(r)[:3] for r in points.collect()])
    x, w = rows[:, :2], rows[:, 2]

    def cost(c):
        return (((x[:, None] - c[None]) ** 2).sum(-1).min(1) * w).sum()

    def lloyd(seed):
        c = x[np.random.default_rng(seed).choice(len(x), 5, replace=False)]
        for _ in range(50):
            near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            c = np.array([np.average(x[near == k], axis=0, weights=w[near == k]) for k in range(5)])
        return cost(c)

    fitted = cost(np.array(fit_and_assign(points)[1].clusterCenters()))
    assert fitted <= 1.1 * min(lloyd(s) for s in range(5))
