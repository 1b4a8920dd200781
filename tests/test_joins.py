"""Dimension joins: shuffled, salted and broadcast joins give the same answers, a
hot key stays correct, and nothing runs before an action."""

import contextlib
import datetime as dt

import pytest

from farewise.operators.enrich import attach_zones
from farewise.operators.explore import pickups_per_zone
from farewise.plans import catalog as cat
from farewise.plans.explain import plan_text
from farewise.plans.hotspots import cluster_stats, zone_window_stats
from farewise.operators.clean import clean_trips

from conftest import SF_SMALL

TRIP_SCHEMA = (
    "trip_id bigint, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
    "passenger_count double, trip_distance double, pulocationid bigint, dolocationid bigint, "
    "tip_amount double, total_amount double"
)


@contextlib.contextmanager
def no_auto_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_left_join_shuffle_path_equals_broadcast(spark):
    trips, zones = cat.trips(spark, SF_SMALL), cat.zones(spark, SF_SMALL)
    small = _sorted(attach_zones(trips, zones))
    with no_auto_broadcast(spark):
        big = attach_zones(trips, zones, salt_buckets=8)
        plan = plan_text(big)
        assert "BroadcastHashJoin" not in plan
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert "xxhash64" in plan  # salted
        assert big.columns == attach_zones(trips, zones).columns
        assert small == _sorted(big)


def test_window_stats_shuffle_path_equals_broadcast(spark):
    trips, zones = cat.trips(spark, SF_SMALL), cat.zones(spark, SF_SMALL)
    def canon(df):
        return [(r[0], r[1], r[2], round(r[3], 6), round(r[4], 6)) for r in _sorted(df)]

    a = canon(zone_window_stats(trips, zones, "15:00:00"))
    with no_auto_broadcast(spark):
        b = zone_window_stats(trips, zones, "15:00:00")
        assert "BroadcastHashJoin" not in plan_text(b)
        assert a == canon(b)


def test_salted_join_spreads_a_hot_key(spark):
    from pyspark.sql import functions as F

    from farewise.operators.joins import salted_join

    fact = spark.range(30000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.range(50).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    with no_auto_broadcast(spark):
        out = salted_join(fact, dim, "k", "key", "left", 8)
        rows = out.select("id", "k", "v").collect()
    assert len(rows) == 30000
    assert all(r["v"] == r["k"] * 10 for r in rows)
    # the hot key's rows are spread over all salt buckets
    salts = fact.select(F.pmod(F.xxhash64("id", "k"), F.lit(8)).alias("s")).where("k = 0").distinct()
    assert salts.count() == 8


def test_hot_location_holding_a_third_of_trips(spark):
    """One pickup location holds a third of all trips: counts and cluster
    statistics stay exact (partial aggregation, no key shipped whole)."""
    base = dt.datetime(2024, 1, 3, 15, 0)
    rows = []
    for i in range(3000):
        loc = 0 if i % 3 == 0 else 1 + i % 24
        rows.append((i, base, base, 1.0, 1.0, loc, 1, 1.0, float(i % 50)))
    trips = clean_trips(spark.createDataFrame(rows, TRIP_SCHEMA).repartition(8))
    zones = cat.zones(spark, SF_SMALL)
    per_zone = dict(tuple(r) for r in pickups_per_zone(trips, zones).collect())
    assert per_zone["NATION_0"] == 1000
    assert sum(per_zone.values()) == 3000
    clusters = cluster_stats(zone_window_stats(trips, zones, "15:00"))
    assert sum(r["trips"] for r in clusters.collect()) == 3000


def test_trip_level_fit_salted_path_equals_broadcast(spark):
    from farewise.plans.hotspots import trip_level_cluster_stats

    trips, zones = cat.trips(spark, SF_SMALL), cat.zones(spark, SF_SMALL)

    def canon(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())

    a = canon(trip_level_cluster_stats(trips, zones, "15:00:00"))
    with no_auto_broadcast(spark):
        b = canon(trip_level_cluster_stats(trips, zones, "15:00:00", salt_buckets=8))
    assert a == b


@pytest.mark.parametrize("how", ["right", "full", "left_anti", "cross"])
def test_joins_that_keep_dimension_rows_are_refused(spark, how):
    trips, zones = cat.trips(spark, SF_SMALL), cat.zones(spark, SF_SMALL)
    with pytest.raises(ValueError):
        attach_zones(trips, zones, how=how)
    with pytest.raises(ValueError):
        attach_zones(trips, zones, how=how, salt_buckets=4)


def test_attaching_zones_runs_no_job(spark):
    trips, zones = cat.trips(spark, SF_SMALL), cat.zones(spark, SF_SMALL)
    group = "attach-zones-is-lazy"
    spark.sparkContext.setJobGroup(group, group)
    try:
        attach_zones(trips, zones)
        pickups_per_zone(trips, zones)
        zone_window_stats(trips, zones, "15:00:00")
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
