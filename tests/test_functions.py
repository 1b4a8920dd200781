"""Scalar functions: WKT parsing, vertex mean, haversine, time of day, price."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from farewise.functions.geo import (
    EARTH_RADIUS_MI,
    haversine_miles,
    register_sql_functions,
    vertex_center,
    wkt_vertices,
)
from farewise.functions.price import expected_price
from farewise.functions.timeofday import parse_time_of_day


def _one(spark, expr, value, schema="g string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_wkt_vertices_basic(spark):
    got = _one(spark, wkt_vertices("g"), "MULTIPOLYGON (((-74.25 40.5, -74.249 40.5, -74.25 40.5)))")
    assert got == [[-74.25, 40.5], [-74.249, 40.5], [-74.25, 40.5]]


def test_wkt_empty_and_null(spark):
    assert _one(spark, wkt_vertices("g"), "MULTIPOLYGON EMPTY") == []
    assert _one(spark, vertex_center(wkt_vertices("g")), "MULTIPOLYGON EMPTY") is None
    assert _one(spark, vertex_center(wkt_vertices("g")), None) is None


def test_integer_coordinates_are_not_matched(spark):
    # Both numbers need a decimal point: "-74 40.5" is skipped.
    got = _one(spark, wkt_vertices("g"), "MULTIPOLYGON (((-74 40.5, -73.5 40.5)))")
    assert got == [[-73.5, 40.5]]


def test_vertex_center_matches_numpy(spark):
    rng = random.Random(7)
    rows = []
    for i in range(20):
        n = rng.randint(5, 955)
        pts = [(round(rng.uniform(-74.3, -73.7), 6), round(rng.uniform(40.5, 40.9), 6)) for _ in range(n)]
        wkt = "MULTIPOLYGON (((" + ", ".join(f"{x} {y}" for x, y in pts) + ")))"
        rows.append((i, wkt, pts))
    df = spark.createDataFrame([(i, w) for i, w, _ in rows], "i int, g string")
    got = {r["i"]: r["c"] for r in df.select("i", vertex_center(wkt_vertices("g")).alias("c")).collect()}
    for i, _, pts in rows:
        expect = np.mean(pts, axis=0).tolist()
        assert got[i] == pytest.approx(expect, rel=0, abs=1e-12)


@settings(max_examples=25, deadline=None)
@given(
    st.floats(-80, 80), st.floats(-179, 179), st.floats(-80, 80), st.floats(-179, 179)
)
def test_haversine_properties(spark, lat1, lon1, lat2, lon2):
    df = spark.createDataFrame([(lat1, lon1, lat2, lon2)], "a double, b double, c double, d double")
    r = df.select(
        haversine_miles("a", "b", "c", "d").alias("d1"),
        haversine_miles("c", "d", "a", "b").alias("d2"),
        haversine_miles("a", "b", "a", "b").alias("d0"),
    ).first()
    assert r["d1"] == pytest.approx(r["d2"], abs=1e-6)
    assert r["d0"] == pytest.approx(0.0, abs=1e-9)
    assert 0.0 <= r["d1"] <= math.pi * EARTH_RADIUS_MI + 1e-6


def test_haversine_known_distance(spark):
    # Times Square to Wall Street, ~4.0 miles.
    df = spark.createDataFrame([(40.7580, -73.9855, 40.7060, -74.0088)], "a double, b double, c double, d double")
    d = df.select(haversine_miles("a", "b", "c", "d").alias("d")).first()["d"]
    assert 3.7 < d < 4.1


def test_sql_function_surface(spark):
    names = register_sql_functions(spark)
    assert names == ["wkt_vertices", "vertex_center", "haversine_mi"]
    r = spark.sql(
        "SELECT wkt_vertices('MULTIPOLYGON (((1.5 2.5, 3.5 4.5)))') AS v, "
        "vertex_center(wkt_vertices('MULTIPOLYGON (((1.5 2.5, 3.5 4.5)))')) AS c, "
        "haversine_mi(40.0, -74.0, 40.0, -74.0) AS d"
    ).first()
    assert r["v"] == [[1.5, 2.5], [3.5, 4.5]]
    assert r["c"] == [2.5, 3.5]
    assert r["d"] == 0.0


@pytest.mark.parametrize(
    "text,minutes",
    [("15:00:00", 900), ("15:00", 900), ("00:10:00", 10), ("23:45:59", 1425), ("7:05", 425)],
)
def test_parse_time_of_day(text, minutes):
    assert parse_time_of_day(text) == minutes


@pytest.mark.parametrize("bad", [":00", "", None, "24:00", "12:60", "noon", "12:00:00:00"])
def test_parse_time_of_day_rejects(bad):
    with pytest.raises(ValueError):
        parse_time_of_day(bad)


def test_expected_price_rounds_half_up(spark):
    df = spark.createDataFrame([(-3.0, 0.5), (2.0, 0.5), (10.2, 1.1)], "r double, t double")
    got = [row["p"] for row in df.select(expected_price("r", "t").alias("p")).collect()]
    assert got == [-2, 3, 11]
