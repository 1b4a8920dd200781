"""Weighted zone-level k-means vs trip-level k-means vs a brute-force answer,
on random layouts of well separated blobs (where the right clustering is the
blob each zone was drawn from)."""

import datetime as dt
import math
import random

import pytest

from farewise.functions.geo import EARTH_RADIUS_MI
from farewise.operators.clean import clean_trips
from farewise.plans.hotspots import hotspots
from farewise.sources.zones import zone_points

TRIP_SCHEMA = (
    "trip_id bigint, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
    "passenger_count double, trip_distance double, pulocationid bigint, dolocationid bigint, "
    "tip_amount double, total_amount double"
)
ZONE_SCHEMA = "locationid string, zone string, borough string, the_geom string"


def _hav(lat1, lon1, lat2, lon2):
    la1, lo1, la2, lo2 = map(math.radians, (lat1, lon1, lat2, lon2))
    d = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * EARTH_RADIUS_MI * math.asin(math.sqrt(d))


@pytest.mark.parametrize("seed", [3, 11, 29])
def test_zone_and_trip_fits_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    zones, trips, blob_of, pts = [], [], {}, {}
    centres = [(-74.3 + 0.2 * b + rng.uniform(0, 0.05), 40.5 + 0.15 * ((b * 3) % 5)) for b in range(5)]
    zid = 0
    for b, (cx, cy) in enumerate(centres):
        for _ in range(rng.randint(2, 6)):
            xs, ys = f"{cx + rng.uniform(-0.01, 0.01):.5f}", f"{cy + rng.uniform(-0.01, 0.01):.5f}"
            zones.append((str(zid), f"Z{zid}", f"B{b}", f"MULTIPOLYGON ((({xs} {ys})))"))
            pts[zid] = (float(xs), float(ys))
            blob_of[zid] = b
            zid += 1
    base = dt.datetime(2024, 1, 5, 15, 0)
    tid = 0
    for z in range(zid):
        for _ in range(rng.randint(1, 40)):
            ts = base + dt.timedelta(minutes=rng.randint(-30, 30))
            total = round(rng.uniform(5, 80), 2)
            trips.append((tid, ts, ts, 1.0, 1.0, z, 0, round(total * 0.2, 2), total))
            tid += 1
    zdf = zone_points(spark.createDataFrame(zones, ZONE_SCHEMA))
    tdf = clean_trips(spark.createDataFrame(trips, TRIP_SCHEMA))

    # brute force: clusters are the blobs; statistics are plain means over trips
    groups = {}
    for t in trips:
        b = blob_of[t[5]]
        groups.setdefault(b, []).append((pts[t[5]], t[7], t[8]))
    expect = []
    for rows in groups.values():
        n = len(rows)
        cx = sum(p[0] for p, _, _ in rows) / n
        cy = sum(p[1] for p, _, _ in rows) / n
        rev = sum(r for _, _, r in rows) / n
        tip = sum(t for _, t, _ in rows) / n
        expect.append((round(_hav(cy, cx, 40.7, -73.9), 6), round(cx, 6), round(cy, 6),
                       round(rev, 6), round(tip, 6), n))
    expect = sorted(expect)[:3]

    for fit_on in ("zones", "trips"):
        got = [
            (round(r["distance_mi"], 6), round(r["centroid_long"], 6), round(r["centroid_lat"], 6),
             round(r["avg_revenue"], 6), round(r["avg_tip"], 6), r["trips"])
            for r in hotspots(tdf, zdf, "15:00", 40.7, -73.9, fit_on=fit_on).orderBy("rank").collect()
        ]
        assert got == expect, fit_on
