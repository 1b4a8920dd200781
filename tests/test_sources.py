"""Sources and sinks: curated store round trip, schema profile, preview,
incremental (streaming) load."""

from pyspark.sql import functions as F

from farewise.fixtures import raw_trips
from farewise.operators.clean import clean_trips
from farewise.sources.profile import preview, schema_profile, schema_text
from farewise.sources.trips import load_trips, read_store
from farewise.streaming.ingest import start_trip_ingest

from conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_load_roundtrip_equals_clean(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    path = load_trips(raw, f"{tmp_dir}/curated")
    back = read_store(spark, path)
    cols = ["trip_id", "passenger_count", "pickup_hour", "pickup_minute", "total_amount"]
    assert _rows(back, cols) == _rows(clean_trips(raw), cols)
    # full refresh: loading again replaces, never appends
    load_trips(raw, path)
    assert read_store(spark, path).count() == clean_trips(raw).count()


def test_schema_profile_and_text(spark):
    raw = raw_trips(spark, SF_SMALL)
    prof = dict(tuple(r) for r in schema_profile(raw).collect())
    assert prof["tpep_pickup_datetime"] == "timestamp_ntz"
    assert prof["pulocationid"] == "bigint"
    assert prof["passenger_count"] == "double"
    assert len(prof) == len(raw.columns)
    assert "trip_id: long" in schema_text(raw)


def test_preview_is_ordered(spark):
    got = [r["trip_id"] for r in preview(raw_trips(spark, SF_SMALL), 5, ["trip_id"]).collect()]
    assert got == sorted(got) and len(got) == 5


def test_streaming_ingest_is_incremental_and_exactly_once(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    day = F.dayofmonth("tpep_pickup_datetime")
    src, dst, ck = f"{tmp_dir}/landing", f"{tmp_dir}/curated", f"{tmp_dir}/ckpt"
    raw.filter(day <= 10).write.parquet(f"{src}/m1")
    # a later month whose column names are upper-case
    later = raw.filter(day > 10)
    later.toDF(*[c.upper() for c in later.columns]).write.parquet(f"{tmp_dir}/stage2")

    q = start_trip_ingest(spark, f"{src}/*", dst, ck)
    q.awaitTermination(120)
    first = read_store(spark, dst).count()
    assert first == clean_trips(raw.filter(day <= 10)).count()

    # same input again: nothing new
    q = start_trip_ingest(spark, f"{src}/*", dst, ck)
    q.awaitTermination(120)
    assert read_store(spark, dst).count() == first

    spark.read.parquet(f"{tmp_dir}/stage2").write.parquet(f"{src}/m2")
    q = start_trip_ingest(spark, f"{src}/*", dst, ck)
    q.awaitTermination(120)
    cols = ["trip_id", "pickup_hour", "pickup_minute", "total_amount"]
    assert _rows(read_store(spark, dst), cols) == _rows(clean_trips(raw), cols)


def test_load_trip_files_from_monthly_paths(spark, tmp_dir):
    from farewise.sources.trips import load_trip_files

    raw = raw_trips(spark, SF_SMALL)
    day = F.dayofmonth("tpep_pickup_datetime")
    a, b = raw.filter(day <= 15), raw.filter(day > 15)
    a.write.parquet(f"{tmp_dir}/m1")
    b.toDF(*[c.upper() for c in b.columns]).write.parquet(f"{tmp_dir}/m2")
    target = load_trip_files(spark, [f"{tmp_dir}/m1", f"{tmp_dir}/m2"], f"{tmp_dir}/curated")
    cols = ["trip_id", "pickup_hour", "pickup_minute", "passenger_count"]
    assert _rows(read_store(spark, target), cols) == _rows(clean_trips(raw), cols)


def test_streaming_ingest_continuous_trigger(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    src, dst, ck = f"{tmp_dir}/landing", f"{tmp_dir}/curated", f"{tmp_dir}/ckpt"
    raw.write.parquet(f"{src}/m1")
    raw.write.parquet(f"{src}/m2")
    q = start_trip_ingest(spark, f"{src}/*", dst, ck,
                          available_now=False, poll="1 second", max_files_per_trigger=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert read_store(spark, dst).count() == 2 * clean_trips(raw).count()


def _drifted(raw):
    """The same trips as another month delivers them: whole passenger counts, shouted names."""
    f = raw.withColumn("passenger_count", F.col("passenger_count").cast("bigint"))
    return f.toDF(*[c.upper() for c in f.columns])


COLS = ["trip_id", "pickup_hour", "pickup_minute", "total_amount"]


def test_ingest_with_defaults_goes_on_where_it_ended(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    day = F.dayofmonth("tpep_pickup_datetime")
    src, dst = f"{tmp_dir}/landing", f"{tmp_dir}/curated"
    raw.filter(day <= 10).write.parquet(f"{src}/m1")
    start_trip_ingest(spark, f"{src}/*", dst).awaitTermination(120)
    raw.filter(day > 10).write.parquet(f"{src}/m2")
    start_trip_ingest(spark, f"{src}/*", dst).awaitTermination(120)
    start_trip_ingest(spark, f"{src}/*", dst).awaitTermination(120)
    assert _rows(read_store(spark, dst), COLS) == _rows(clean_trips(raw), COLS)


def test_ingest_adds_to_a_batch_loaded_store(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    day = F.dayofmonth("tpep_pickup_datetime")
    src, dst = f"{tmp_dir}/landing", f"{tmp_dir}/curated"
    load_trips(raw.filter(day <= 10), dst)
    raw.filter(day > 10).write.parquet(f"{src}/m2")
    start_trip_ingest(spark, f"{src}/*", dst).awaitTermination(120)
    assert _rows(read_store(spark, dst), COLS) == _rows(clean_trips(raw), COLS)


def test_ingest_takes_files_whose_types_drift(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    day = F.dayofmonth("tpep_pickup_datetime")
    src, dst = f"{tmp_dir}/landing", f"{tmp_dir}/curated"
    raw.filter(day <= 10).write.parquet(f"{src}/m1")
    _drifted(raw.filter(day > 10)).write.parquet(f"{src}/m2")
    start_trip_ingest(spark, f"{src}/*", dst).awaitTermination(120)
    assert _rows(read_store(spark, dst), COLS) == _rows(clean_trips(raw), COLS)


def test_one_month_reloads_alone(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    later = raw.withColumns({c: F.col(c) + F.expr("INTERVAL '62' DAY") for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")})
    dst = load_trips(raw.unionByName(later), f"{tmp_dir}/curated")
    again = later.filter("trip_id % 2 = 0")
    load_trips(again, dst, mode="months")
    assert _rows(read_store(spark, dst), COLS) == _rows(clean_trips(raw.unionByName(again)), COLS)


def test_a_hot_hour_is_split_without_aqe(spark, tmp_dir):
    from pyspark.sql import functions as F

    hot = F.when(F.col("trip_id") % 10 < 9, F.lit("2024-01-03 15:00:00")).otherwise(F.lit("2024-01-03 04:00:00"))
    raw = raw_trips(spark, SF_SMALL).withColumn("tpep_pickup_datetime", hot.cast("timestamp_ntz"))
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dst = load_trips(raw, f"{tmp_dir}/curated")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    files = spark.read.parquet(dst).filter("pickup_hour = 15").groupBy(F.input_file_name()).count().collect()
    total = sum(r["count"] for r in files)
    assert len(files) >= 6 and max(r["count"] for r in files) < 0.4 * total


def test_store_filters_prune_folders_and_reach_the_scan(spark, tmp_dir):
    from farewise.operators.window import time_window
    from farewise.plans.explain import plan_text

    dst = load_trips(raw_trips(spark, SF_SMALL), f"{tmp_dir}/curated")
    plan = plan_text(time_window(read_store(spark, dst), "15:00"))
    assert "PartitionFilters: [isnotnull(pickup_hour" in plan and "GreaterThanOrEqual(pickup_minute" in plan


def test_a_file_with_both_spellings_is_named(spark, tmp_dir):
    import pyarrow as pa
    import pyarrow.parquet as pq
    import pytest

    from farewise.sources.trips import read_trip_files

    path = f"{tmp_dir}/both.parquet"
    pq.write_table(pa.table({"trip_id": [1], "Airport_fee": [1.0], "airport_fee": [2.0]}), path)
    with pytest.raises(ValueError, match="both.parquet.*airport_fee"):
        read_trip_files(spark, [path])
