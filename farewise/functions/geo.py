"""Geometry and distance as native column expressions.

* ``wkt_vertices``: every ``x y`` pair of a WKT string as ``array<array<double>>``.
* ``vertex_center``: unweighted mean of all vertices (closing vertex and holes
  included), i.e. the vertex mean and *not* an area centroid.
* ``haversine_miles``: great-circle distance on the mean earth radius.

All three are also available to SQL users through ``register_sql_functions``.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The coordinate-pair pattern (both numbers need a decimal point,
# exactly one whitespace character between them) and the distance constants
# (mean earth radius in km, km to statute miles).
WKT_PAIR_PATTERN = r"(-?\d+\.\d+\s-?\d+\.\d+)"
EARTH_RADIUS_KM = 6371.0088
KM_TO_MILES = 0.621371192
EARTH_RADIUS_MI = EARTH_RADIUS_KM * KM_TO_MILES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wkt_vertices(geom: Column | str) -> Column:
    """All coordinate pairs of a WKT geometry string; null for a null input."""
    pairs = F.regexp_extract_all(_col(geom), F.lit(WKT_PAIR_PATTERN), 1)
    return F.transform(
        pairs, lambda p: F.transform(F.split(p, r"\s"), lambda x: x.cast("double"))
    )


def vertex_center(vertices: Column | str) -> Column:
    """``array(mean x, mean y)``; null when there is no vertex or no input."""
    v = _col(vertices)
    n = F.size(v)
    sum_x = F.aggregate(v, F.lit(0.0), lambda acc, p: acc + F.get(p, 0))
    sum_y = F.aggregate(v, F.lit(0.0), lambda acc, p: acc + F.get(p, 1))
    return F.when(n > 0, F.array(sum_x / n, sum_y / n))


def haversine_miles(
    lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str
) -> Column:
    """Great-circle distance in statute miles between two (lat, lon) points."""
    la1, lo1, la2, lo2 = (F.radians(_col(c).cast("double")) for c in (lat1, lon1, lat2, lon2))
    s_lat = F.sin((la2 - la1) * 0.5)
    s_lon = F.sin((lo2 - lo1) * 0.5)
    d = s_lat * s_lat + F.cos(la1) * F.cos(la2) * s_lon * s_lon
    return F.lit(2.0 * EARTH_RADIUS_MI) * F.asin(F.sqrt(F.least(F.lit(1.0), d)))


def _sql_literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create session-scoped SQL functions ``wkt_vertices``, ``vertex_center``
    and ``haversine_mi`` whose bodies are the same native expressions."""
    pattern = _sql_literal(WKT_PAIR_PATTERN)
    split = _sql_literal(r"\s")
    statements = [
        f"""CREATE OR REPLACE TEMPORARY FUNCTION wkt_vertices(g STRING)
            RETURNS ARRAY<ARRAY<DOUBLE>>
            RETURN transform(regexp_extract_all(g, {pattern}, 1),
                             p -> transform(split(p, {split}), x -> CAST(x AS DOUBLE)))""",
        """CREATE OR REPLACE TEMPORARY FUNCTION vertex_center(v ARRAY<ARRAY<DOUBLE>>)
            RETURNS ARRAY<DOUBLE>
            RETURN CASE WHEN size(v) > 0 THEN array(
                aggregate(v, CAST(0.0 AS DOUBLE), (acc, p) -> acc + get(p, 0)) / size(v),
                aggregate(v, CAST(0.0 AS DOUBLE), (acc, p) -> acc + get(p, 1)) / size(v)) END""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_mi(
                lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)
            RETURNS DOUBLE
            RETURN {2.0 * EARTH_RADIUS_MI!r} * asin(sqrt(least(1.0D,
                sin((radians(lat2) - radians(lat1)) * 0.5) * sin((radians(lat2) - radians(lat1)) * 0.5)
                + cos(radians(lat1)) * cos(radians(lat2))
                  * sin((radians(lon2) - radians(lon1)) * 0.5) * sin((radians(lon2) - radians(lon1)) * 0.5))))""",
    ]
    for stmt in statements:
        spark.sql(stmt)
    return ["wkt_vertices", "vertex_center", "haversine_mi"]
