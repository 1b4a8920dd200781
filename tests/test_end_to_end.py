"""The public API the way a user runs it: monthly trip files and a zones CSV
→ curated store → hotspots; same answer as the registered flagship query."""

from pyspark.sql import functions as F

from farewise import hotspots, load_trip_files, read_store, read_zones_csv, zone_points
from farewise.fixtures import USER_LAT, USER_LONG, raw_trips, raw_zones
from farewise.plans import catalog as cat

from conftest import SF_SMALL


def test_files_to_hotspots(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    day = F.dayofmonth("tpep_pickup_datetime")
    months = []
    for i, (lo, hi) in enumerate(((1, 10), (11, 20), (21, 31))):
        part = raw.filter(day.between(lo, hi))
        if i == 1:  # a month whose writer used other column case
            part = part.toDF(*[c.upper() for c in part.columns])
        months.append(f"{tmp_dir}/yellow_{i + 1}.parquet")
        part.write.parquet(months[-1])
    raw_zones(spark, SF_SMALL).write.option("header", True).csv(f"{tmp_dir}/zones_csv")

    curated = load_trip_files(spark, months, f"{tmp_dir}/curated")
    zones = zone_points(read_zones_csv(spark, f"{tmp_dir}/zones_csv"))
    got = cat.rounded(hotspots(read_store(spark, curated), zones, "15:00", USER_LAT, USER_LONG))
    want = cat.q_hotspots(spark, SF_SMALL)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
