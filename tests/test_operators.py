"""Cleaning, time window, borough predicate, joins, unions, top-k."""

import datetime as dt
import math


from farewise.operators.clean import clean_trips, drop_incomplete
from farewise.operators.enrich import attach_zones, filter_borough, with_point
from farewise.operators.explore import best_pickup_locations, top_pickup_zones
from farewise.operators.window import time_window
from farewise.sources.trips import normalize_columns, positional_union, read_trip_files
from farewise.sources.zones import read_zones_csv, zone_points

from conftest import SF_SMALL

TRIP_SCHEMA = (
    "trip_id bigint, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
    "passenger_count double, trip_distance double, pulocationid bigint, dolocationid bigint, "
    "tip_amount double, total_amount double"
)


def _trip(i, h, m, loc=1, pc=1.0, total=10.0, tip=1.0):
    ts = dt.datetime(2024, 1, 1 + i % 28, h, m, 30)
    return (i, ts, ts + dt.timedelta(minutes=17), pc, 1.5, loc, 2, tip, total)


def test_drop_incomplete_counts_nan_as_null(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "y"), (None, "z"), (2.0, None)], "a double, b string")
    assert [tuple(r) for r in drop_incomplete(df).collect()] == [(1.0, "x")]


def test_clean_truncates_passenger_count(spark):
    df = spark.createDataFrame([_trip(1, 15, 0, pc=2.5), _trip(2, 15, 0, pc=6.9)], TRIP_SCHEMA)
    got = sorted(r["passenger_count"] for r in clean_trips(df).collect())
    assert got == [2, 6]
    assert dict(clean_trips(df).dtypes)["trip_distance"] == "float"


def test_time_window_no_wrap_at_midnight(spark):
    rows = [_trip(1, 23, 45), _trip(2, 0, 5), _trip(3, 0, 40), _trip(4, 0, 41)]
    trips = clean_trips(spark.createDataFrame(rows, TRIP_SCHEMA))
    plain = sorted(r["trip_id"] for r in time_window(trips, "00:10:00").collect())
    assert plain == [2, 3]  # 23:45 is 1415 minutes away without wrapping
    late = sorted(r["trip_id"] for r in time_window(trips, "23:45:00").collect())
    assert late == [1]
    wrapped = sorted(r["trip_id"] for r in time_window(trips, "23:45:00", wrap_midnight=True).collect())
    assert wrapped == [1, 2]
    diffs = {r["trip_id"]: r["time_diff"] for r in time_window(trips, "23:45:00", wrap_midnight=True).collect()}
    assert diffs == {1: 0, 2: 20}


def test_time_window_bounds_inclusive(spark):
    rows = [_trip(1, 14, 30), _trip(2, 15, 30), _trip(3, 14, 29), _trip(4, 15, 31)]
    trips = clean_trips(spark.createDataFrame(rows, TRIP_SCHEMA))
    assert sorted(r["trip_id"] for r in time_window(trips, "15:00").collect()) == [1, 2]


def test_borough_filter_the_bronx(spark):
    df = spark.createDataFrame([("Bronx",), ("Manhattan",), ("the bronx",)], "borough string")
    assert filter_borough(df, "The Bronx").count() == 2
    assert filter_borough(df, "MANHATTAN").count() == 1
    assert filter_borough(df, "").count() == 3
    assert filter_borough(df, None).count() == 3


def test_left_join_keeps_unmatched_and_with_point_drops(spark):
    trips = clean_trips(spark.createDataFrame([_trip(1, 15, 0, loc=1), _trip(2, 15, 0, loc=99)], TRIP_SCHEMA))
    zones = zone_points(spark.createDataFrame(
        [("1", "Z1", "B", "MULTIPOLYGON (((1.5 2.5, 3.5 4.5)))")],
        "locationid string, zone string, borough string, the_geom string"))
    joined = attach_zones(trips, zones)
    got = {r["trip_id"]: r["zone"] for r in joined.collect()}
    assert got == {1: "Z1", 2: None}
    assert [r["trip_id"] for r in with_point(joined).collect()] == [1]


def test_top_k_tie_break_and_null_zone_group(spark):
    rows = [_trip(i, 10, 0, loc=1 + i % 3) for i in range(9)] + [_trip(100 + i, 10, 0, loc=50) for i in range(5)]
    trips = clean_trips(spark.createDataFrame(rows, TRIP_SCHEMA))
    top = [tuple(r) for r in best_pickup_locations(trips, 2).collect()]
    assert top == [(50, 5), (1, 3)]
    zones = zone_points(spark.createDataFrame(
        [(str(i), f"Z{i}", "B", "MULTIPOLYGON (((1.5 2.5, 3.5 4.5)))") for i in (1, 2, 3)],
        "locationid string, zone string, borough string, the_geom string"))
    zt = [tuple(r) for r in top_pickup_zones(trips, zones, 10).collect()]
    assert zt[0] == (None, 5)
    assert sorted(zt[1:]) == [("Z1", 3), ("Z2", 3), ("Z3", 3)]


def test_union_names_and_types(spark):
    a = spark.createDataFrame([(1, 1.5)], "id int, airport_fee double")
    b = spark.createDataFrame([(2, 2)], "id int, Airport_fee int")
    u = positional_union([a, b])
    assert u.columns == ["id", "airport_fee"]
    assert dict(u.dtypes)["airport_fee"] == "double"
    assert normalize_columns(b).columns == ["id", "airport_fee"]


def test_read_trip_files_groups_by_schema(spark, tmp_dir):
    a = spark.createDataFrame([(1, 1.5)], "id int, airport_fee double")
    b = spark.createDataFrame([(2, 2)], "ID int, Airport_fee int")
    c = spark.createDataFrame([(3, 3.5)], "id int, airport_fee double")
    paths = []
    for i, df in enumerate((a, b, c)):
        paths.append(f"{tmp_dir}/m{i}")
        df.write.parquet(paths[-1])
    got = read_trip_files(spark, paths)
    assert got.columns == ["id", "airport_fee"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1.5), (2, 2.0), (3, 3.5)]


def test_zones_csv_keeps_commas_inside_wkt(spark, tmp_dir):
    path = f"{tmp_dir}/zones.csv"
    with open(path, "w") as f:
        f.write('OBJECTID,Shape_Leng,the_geom,Shape_Area,zone,LocationID,borough\n')
        f.write('1,0.1,"MULTIPOLYGON (((-74.1 40.6, -74.0 40.6, -74.0 40.7)))",0.2,Newark Airport,1,EWR\n')
        f.write('2,0.1,MULTIPOLYGON EMPTY,0.2,Nowhere,2,Queens\n')
    z = read_zones_csv(spark, path)
    assert all(t == "string" for _, t in z.dtypes)
    pts = {r["locationid"]: r for r in zone_points(z).collect()}
    assert pts[1]["n_vertices"] == 3
    assert math.isclose(pts[1]["long"], (-74.1 - 74.0 - 74.0) / 3)
    assert pts[2]["long"] is None and pts[2]["n_vertices"] == 0


def test_normalize_merges_columns_equal_up_to_case(spark):
    for sensitive in ("true", "false"):
        spark.conf.set("spark.sql.caseSensitive", sensitive)
        try:
            df = spark.createDataFrame([(1, None, 2.5), (2, 1.25, None), (3, 4.0, 5.0)],
                                       "id int, Airport_fee double, airport_fee double")
            out = normalize_columns(df)
            assert out.columns == ["id", "airport_fee"]
            assert sorted(tuple(r) for r in out.collect()) == [(1, 2.5), (2, 1.25), (3, 4.0)]
        finally:
            spark.conf.set("spark.sql.caseSensitive", "false")


def test_read_trip_files_one_scan_per_schema(spark, tmp_dir):
    from farewise.plans.explain import plan_text

    a = spark.createDataFrame([(1, 1.5)], "id int, airport_fee double")
    b = spark.createDataFrame([(2, 2)], "ID int, Airport_fee int")
    paths = []
    for i, df in enumerate((a, b, a, a)):
        paths.append(f"{tmp_dir}/s{i}")
        df.write.parquet(paths[-1])
    got = read_trip_files(spark, paths)
    plan = plan_text(got, "simple")
    assert plan.count("FileScan parquet") == 2  # three alike files in one scan, the odd one in another
    assert got.count() == 4


def test_zone_queries_return_zones_without_trips(spark):
    from farewise.plans import catalog as cat
    from farewise.plans.explain import plan_text

    zones = spark.read.parquet(f"{SF_SMALL}/nation.parquet").count()
    used = cat.trips(spark, SF_SMALL).select("pulocationid").distinct().count()
    assert used < zones
    for q in (cat.q_zones_project, cat.q_zone_centroids, cat.q_zones_csv):
        assert q(spark, SF_SMALL).count() == zones
    vertices = cat.q_zone_vertices(spark, SF_SMALL)
    assert vertices.select("locationid").distinct().count() == zones
    for q in (cat.q_zones_project, cat.q_zone_centroids, cat.q_zone_vertices):
        assert "events.parquet" not in plan_text(q(spark, SF_SMALL))
