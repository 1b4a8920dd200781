"""Hotspots for tables of requests: the rows of one request at a time, in a fixed number of jobs."""

import datetime as dt
import random
import uuid

import pytest

from farewise.fixtures import USER_LAT, USER_LONG, REQUESTS_FX, stand_in
from farewise.operators.clean import clean_trips
from farewise.plans import catalog as cat
from farewise.plans.batch import hotspots_batch, minute_prefix, window_points
from farewise.plans.hotspots import hotspots, zone_minute_stats
from farewise.sources.zones import zone_points

from conftest import SF_SMALL

REQUESTS = "request_id long, time string, lat double, long double, borough string"
TRIPS = (
    "trip_id bigint, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
    "passenger_count double, trip_distance double, pulocationid bigint, dolocationid bigint, "
    "tip_amount double, total_amount double"
)


def _zones(spark, n, seed):
    """Zones scattered at random: clusters overlap."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rnd.uniform(-74.3, -73.7), rnd.uniform(40.5, 40.9)
        rows.append((str(i), f"Z{i}", f"B{i % 3}", f"MULTIPOLYGON ((({x:.4f} {y:.4f}, {x + 0.003:.4f} {y:.4f}, {x:.4f} {y + 0.002:.4f})))"))
    rows.append((str(n), "nowhere", "B0", None))
    return zone_points(spark.createDataFrame(rows, "locationid string, zone string, borough string, the_geom string"))


def _trips(spark, n, zones, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ts = dt.datetime(2024, 1, 1 + i % 28, rnd.choice([0, 7, 8, 15, 15, 15, 23]), rnd.randrange(60))
        loc = 0 if i % 3 == 0 else rnd.randrange(zones + 3)
        rows.append((i, ts, ts, 1.0, 1.0, loc, 1, rnd.randrange(900) / 100, rnd.randrange(9000) / 100))
    return clean_trips(spark.createDataFrame(rows, TRIPS))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _near(df):
    """Rows with doubles to six places: other sums of doubles may differ in the last bit."""
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize(("minutes", "wrap"), [(30, False), (30, True), (400, True), (800, True)])
def test_batch_gives_the_rows_of_single_requests(spark, minutes, wrap):
    zones, trips = _zones(spark, 25, 1).cache(), _trips(spark, 1500, 25, 2).cache()
    asked = [
        (1, "15:00", 40.7, -73.9, None), (2, "15:00:59", 40.5, -74.2, "the b1"), (3, "00:10", 40.6, -74.0, ""),
        (4, "23:50", 40.6, -74.0, " B2 "), (5, "03:30", 40.6, -74.0, "B0"), (6, "08:15", 40.8, -73.8, "elsewhere"),
    ]
    stats = zone_minute_stats(trips)
    got = hotspots_batch(spark.createDataFrame(asked, REQUESTS), stats, zones, window_minutes=minutes, wrap_midnight=wrap)
    want = []
    for i, time, lat, long, borough in asked:
        one = hotspots(trips, zones, time, lat, long, borough, fit="lloyd", window_minutes=minutes, wrap_midnight=wrap)
        want += [(i, *r) for r in one.collect()]
    assert _rows(got) == sorted(want)
    assert want


def test_batch_equals_the_default_fit_on_separate_zones(spark):
    trips, zones = cat.trips(spark, SF_SMALL), cat.zones(spark, SF_SMALL)
    asked = [(1, "15:00", USER_LAT, USER_LONG, None), (2, "08:15", 40.6, -74.1, "Asia")]
    got = hotspots_batch(spark.createDataFrame(asked, REQUESTS), zone_minute_stats(trips), zones)
    want = [(i, *r) for i, t, a, b, of in asked for r in hotspots(trips, zones, t, a, b, of).collect()]
    assert [tuple(round(x, 6) for x in r) for r in _rows(got)] == [tuple(round(x, 6) for x in r) for r in sorted(want)]


def test_requests_without_an_answer(spark):
    zones, trips = _zones(spark, 4, 3), _trips(spark, 50, 4, 4)
    asked = [(1, "25:00", 40.7, -73.9, None), (2, None, 40.7, -73.9, None), (3, "15:00", None, -73.9, None),
             (4, "15:00", 40.7, None, None), (None, "15:00", 40.7, -73.9, None), (5, "soon", 40.7, -73.9, None)]
    got = hotspots_batch(spark.createDataFrame(asked, REQUESTS), zone_minute_stats(trips), zones).collect()
    assert {r["request_id"] for r in got} == {None} and len(got) == 3
    empty = spark.createDataFrame([], REQUESTS)
    assert hotspots_batch(empty, zone_minute_stats(trips), zones).collect() == []


def test_prefix_differences_are_window_sums(spark):
    trips, zones = _trips(spark, 800, 6, 5), _zones(spark, 6, 6)
    minutes = [0, 10, 29, 30, 470, 930, 1409, 1410, 1439]
    pairs = spark.createDataFrame([(m, "") for m in minutes], "minute int, borough string")
    rows = trips.collect()
    points = {r["locationid"]: (r["long"], r["lat"]) for r in zones.collect() if r["long"] is not None}
    for wrap in (False, True):
        got = {(r["minute"], r["long"], r["lat"]): (r["n"], float(r["sum_total"])) for r in
               window_points(pairs, minute_prefix(zone_minute_stats(trips)), zones, 30, wrap).collect()}
        want = {}
        for m in minutes:
            for t in rows:
                far = abs(t["pickup_minute"] - m)
                if t["pulocationid"] in points and (min(far, 1440 - far) if wrap else far) <= 30:
                    key = (m, *points[t["pulocationid"]])
                    n, total = want.get(key, (0, 0))
                    want[key] = n + 1, total + round(t["total_amount"] * 100)
        assert got == {k: (n, total / 100) for k, (n, total) in want.items()}


def test_job_count_does_not_depend_on_the_number_of_requests(spark):
    requests = stand_in(spark, SF_SMALL, REQUESTS_FX)
    zones = cat.zones(spark, SF_SMALL)
    stats = zone_minute_stats(cat.trips(spark, SF_SMALL)).cache()
    stats.count()
    counts = []
    for some in (requests.filter("request_id % 30 = 1"), requests):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "requests")
        answered = hotspots_batch(some, stats, zones).select("request_id").distinct().count()
        counts.append((answered, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1][0] >= 20 * counts[0][0] and counts[1][1] <= counts[0][1] + 2


def test_minute_stats_of_instants_under_a_zone(spark):
    from farewise.plans.hotspots import hotspots_from_minute_stats

    instants = cat._instants(cat.raw_trips(spark, SF_SMALL))
    zones = cat.zones(spark, SF_SMALL)
    direct = hotspots(instants, zones, "15:00", USER_LAT, USER_LONG, zone="Asia/Kolkata")
    landed = hotspots_from_minute_stats(zone_minute_stats(instants, "Asia/Kolkata"), zones, "15:00", USER_LAT, USER_LONG)
    assert _near(direct) == _near(landed)
    assert _near(direct) != _near(hotspots(instants, zones, "15:00", USER_LAT, USER_LONG))


def test_a_raw_file_with_a_derived_name_is_still_cleaned(spark):
    from farewise.operators.clean import is_clean
    from pyspark.sql import functions as F

    raw = cat.raw_trips(spark, SF_SMALL)
    assert is_clean(clean_trips(raw)) and not is_clean(raw.withColumn("pickup_minute", F.lit(5)))
    assert is_clean(clean_trips(raw).select("pickup_hour", "dropoff_hour", "pickup_minute", "total_amount"))
    named = raw.withColumn("pickup_minute", F.lit(5))
    want = zone_minute_stats(raw)
    assert _rows(zone_minute_stats(named)) == _rows(want)
