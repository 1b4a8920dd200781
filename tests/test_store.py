"""The store as published loads, footers read by the tasks, accounts of dropped rows, profiles of records."""

import datetime as dt
import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from farewise.fixtures import raw_trips
from farewise.operators.account import drop_account, observed, quarantined
from farewise.operators.clean import clean_trips, drop_incomplete
from farewise.sources import store, trips as trips_module
from farewise.sources.profile import record_profile
from farewise.sources.store import StoreChanged, load_sizes, published, vacuum
from farewise.sources.trips import append_load, compact_store, load_trips, read_store, read_trip_files
from farewise.streaming.ingest import start_trip_ingest

from conftest import SF_SMALL

COLS = ["trip_id", "pickup_hour", "pickup_minute", "total_amount"]


def _rows(df, cols=COLS):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _day():
    return F.dayofmonth("tpep_pickup_datetime")


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_refresh_replaces_the_store_under_either_setting(spark, tmp_dir, mode):
    raw = raw_trips(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        dst = load_trips(raw, f"{tmp_dir}/curated")
        load_trips(raw.filter(_day() == 3), dst)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    assert _rows(read_store(spark, dst)) == _rows(clean_trips(raw.filter(_day() == 3)))


@pytest.mark.parametrize("load", [load_trips, lambda t, d: load_trips(t, d, mode="months"), lambda t, d: append_load(t, d, "more")])
def test_a_load_that_dies_midway_is_not_seen(spark, tmp_dir, load):
    raw = raw_trips(spark, SF_SMALL)
    dst = load_trips(raw.filter(_day() <= 10), f"{tmp_dir}/curated")
    want = _rows(read_store(spark, dst))
    dies = raw.withColumn("tip_amount", F.when(F.col("trip_id") % 97 == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("tip_amount")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        load(dies, dst)
    assert _rows(read_store(spark, dst)) == want
    # dead between the write and the record: still the version before
    write, store.publish = store.publish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError, match="lost"):
            load(raw, dst)
    finally:
        store.publish = write
    assert _rows(read_store(spark, dst)) == want
    load(raw.filter(_day() > 10), dst)
    assert _rows(read_store(spark, dst)) != want


def test_a_reader_keeps_its_version_until_vacuum(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    dst = load_trips(raw, f"{tmp_dir}/curated")
    old = read_store(spark, dst)
    want = _rows(old)
    load_trips(raw.filter(_day() == 3), dst)
    assert vacuum(spark, dst) == []  # the version before is younger than a week
    assert _rows(old) == want
    first, second = sorted(glob.glob(f"{dst}/load=*"), key=os.path.getmtime)
    assert vacuum(spark, dst, keep_hours=0.0) == [os.path.basename(first).removeprefix("load=")]
    assert glob.glob(f"{dst}/load=*") == [second]
    assert _rows(read_store(spark, dst)) == _rows(clean_trips(raw.filter(_day() == 3)))
    assert published(spark, dst)[0] == 2


def test_two_writers_cannot_publish_one_version(spark, tmp_dir):
    dst = load_trips(raw_trips(spark, SF_SMALL).filter(_day() == 3), f"{tmp_dir}/curated")
    version, loads = published(spark, dst)
    assert store.publish(spark, dst, version, loads) == version + 1
    with pytest.raises(StoreChanged):
        store.publish(spark, dst, version, loads)


def test_compaction_keeps_rows_and_bounds_files(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    dst = load_trips(raw.filter(_day() <= 5), f"{tmp_dir}/curated")
    for d in range(6, 16):
        assert append_load(raw.filter(_day() == d), dst, f"batch-{d}")
    before = read_store(spark, dst)
    want = _rows(before)
    sizes = {r["load"]: r["files"] for r in load_sizes(spark, dst).collect()}
    assert len(sizes) == 11
    assert compact_store(spark, dst, splits=2) == 11
    (_, loads) = published(spark, dst)
    assert len(loads) == 1 and _rows(read_store(spark, dst)) == want == _rows(before)
    files = {r["load"]: r["files"] for r in load_sizes(spark, dst).collect()}[loads[0].folder]
    assert files <= 24 * 2 < sum(sizes.values())  # one month, up to two files an hour
    # a batch that runs again after its load was merged
    assert not append_load(raw.filter(_day() == 6), dst, "batch-6")
    assert _rows(read_store(spark, dst)) == want
    assert compact_store(spark, dst) == 0
    assert append_load(raw.filter(_day() == 16), dst, "batch-16")
    assert compact_store(spark, dst, small_bytes=1) == 0
    assert _rows(read_store(spark, dst)) == _rows(clean_trips(raw.filter(_day() <= 16)))


def test_compaction_sees_replaced_months_and_writers_in_between(spark, tmp_dir, monkeypatch):
    raw = raw_trips(spark, SF_SMALL)
    later = raw.withColumns({c: F.col(c) + F.expr("INTERVAL '62' DAY") for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")})
    dst = load_trips(raw, f"{tmp_dir}/curated")
    append_load(later, dst, "later")
    load_trips(later.filter("trip_id % 2 = 0"), dst, mode="months")
    want = _rows(clean_trips(raw.unionByName(later.filter("trip_id % 2 = 0"))))
    assert _rows(read_store(spark, dst)) == want
    write = store.write_load

    def meanwhile(rows, target, name):
        out = write(rows, target, name)
        if name == "compacted":
            store.add(spark, trips_module.laid_out(clean_trips(raw.filter("trip_id = 1"))), target, "meanwhile")
        return out

    monkeypatch.setattr(store, "write_load", meanwhile)
    assert compact_store(spark, dst) == 3
    monkeypatch.setattr(store, "write_load", write)
    assert _rows(read_store(spark, dst)) == sorted(want + _rows(clean_trips(raw.filter("trip_id = 1"))))


def test_loads_with_other_columns_are_read_together(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    dst = load_trips(raw.filter(_day() <= 5).withColumn("pulocationid", F.col("pulocationid").cast("int")), f"{tmp_dir}/curated")
    append_load(raw.filter(_day() > 5).withColumn("airport_fee", F.lit(1.5)), dst, "wider")
    got = read_store(spark, dst)
    assert _rows(got, [*COLS, "pulocationid"]) == _rows(clean_trips(raw), [*COLS, "pulocationid"])
    assert got.filter("airport_fee IS NULL").count() == clean_trips(raw.filter(_day() <= 5)).count()


def test_an_empty_load_is_a_store(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    dst = load_trips(raw.filter("false"), f"{tmp_dir}/curated")
    assert read_store(spark, dst).columns == clean_trips(raw).columns and read_store(spark, dst).count() == 0
    load_trips(raw, dst, mode="months")
    assert _rows(read_store(spark, dst)) == _rows(clean_trips(raw))


def test_ingest_batches_survive_compaction(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    src, dst = f"{tmp_dir}/landing", f"{tmp_dir}/curated"
    for d in (1, 2, 3):
        raw.filter(_day() == d).coalesce(1).write.parquet(f"{src}/d{d}")
    start_trip_ingest(spark, f"{src}/*", dst, max_files_per_trigger=1).awaitTermination(120)
    assert len(published(spark, dst)[1]) == 3
    assert compact_store(spark, dst) == 3
    raw.filter(_day() == 4).coalesce(1).write.parquet(f"{src}/d4")
    start_trip_ingest(spark, f"{src}/*", dst, max_files_per_trigger=1).awaitTermination(120)
    assert _rows(read_store(spark, dst)) == _rows(clean_trips(raw.filter(_day() <= 4)))
    assert len(published(spark, dst)[1]) == 2


# --- many files -------------------------------------------------------------------


def test_driver_calls_do_not_grow_with_files(spark, tmp_dir, monkeypatch):
    for i in range(130):
        types = pa.float64() if i % 3 else pa.int32()
        name = "Fare" if i % 2 else "fare"
        pq.write_table(pa.table({"trip_id": pa.array([i, i + 1000]), name: pa.array([i, i + 1], types)}), f"{tmp_dir}/f{i:03}.parquet")
    calls = []
    whole = trips_module._schema_of
    monkeypatch.setattr(trips_module, "_schema_of", lambda *a: calls.append(a) or whole(*a))
    paths = sorted(glob.glob(f"{tmp_dir}/*.parquet"))
    got = read_trip_files(spark, paths)
    assert len(calls) == 4  # two types, two spellings
    assert dict(got.dtypes) == {"trip_id": "bigint", "fare": "double"}
    assert sorted(map(tuple, got.collect())) == sorted((t, float(f)) for i in range(130) for t, f in ((i, i), (i + 1000, i + 1)))


def test_paths_that_tasks_cannot_open_are_read_by_spark(spark, tmp_dir, monkeypatch):
    from farewise.sources.footers import schema_key

    raw_trips(spark, SF_SMALL).coalesce(1).write.parquet(f"{tmp_dir}/m1")
    assert schema_key(f"viewfs://store{tmp_dir}/m1") is None and schema_key(f"{tmp_dir}/nothing") is None
    assert schema_key(f"file:{tmp_dir}/m1") == schema_key(f"{tmp_dir}/m1") is not None
    monkeypatch.setattr(trips_module, "files_by_schema", lambda s, p: ([], list(p)))
    assert read_trip_files(spark, [f"{tmp_dir}/m1"]).count() == raw_trips(spark, SF_SMALL).count()


# --- account ------------------------------------------------------------------------

TRIPS = (
    "trip_id bigint, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count double, "
    "trip_distance float, pulocationid bigint, dolocationid bigint, tip_amount double, total_amount double, odd_name string"
)


def test_account_counts_nulls_and_nans(spark, tmp_dir):
    ts, nan = dt.datetime(2024, 1, 2, 15), float("nan")
    rows = [
        (1, ts, ts, 1.0, 1.0, 1, 1, 1.0, 1.0, "x"), (2, ts, ts, None, 1.0, 1, 1, 1.0, 1.0, "x"), (3, ts, ts, nan, nan, 1, 1, 1.0, 1.0, None),
        (4, None, ts, 1.0, 1.0, None, 1, 1.0, 1.0, "x"), (5, ts, ts, 2.5, 1.0, 1, 1, 0.0, 1.0, ""), (None,) * 10,
    ]
    df = spark.createDataFrame(rows, TRIPS)
    account = {r["column_name"]: r["failing"] for r in drop_account(df).collect()}
    assert account == {
        "trip_id": 1, "tpep_pickup_datetime": 2, "tpep_dropoff_datetime": 1, "passenger_count": 3, "trip_distance": 2, "pulocationid": 2,
        "dolocationid": 1, "tip_amount": 1, "total_amount": 1, "odd_name": 2, None: 4,
    }
    held = {r["trip_id"]: r["failing"] for r in quarantined(df).collect()}
    assert held[3] == ["passenger_count", "trip_distance", "odd_name"] and held[4] == ["tpep_pickup_datetime", "pulocationid"]
    assert len(held) == 4 and len(held[None]) == 10
    seen = Observation("load")
    kept = drop_incomplete(observed(df, seen)).count()
    assert (seen.get["rows"], seen.get["dropped"], kept) == (6, 4, 2)
    assert {None if k == "dropped" else k.removeprefix("null_"): v for k, v in seen.get.items() if k != "rows"} == account
    none = {r["failing"] for r in drop_account(df.limit(0)).collect()}
    assert none == {0}


def test_load_with_an_account(spark, tmp_dir):
    raw = raw_trips(spark, SF_SMALL)
    seen = Observation("trips")
    dst = load_trips(raw, f"{tmp_dir}/curated", account=seen, quarantine=f"{tmp_dir}/held")
    kept = read_store(spark, dst).count()
    assert seen.get["rows"] == raw.count() and seen.get["rows"] - seen.get["dropped"] == kept
    held = spark.read.parquet(f"{tmp_dir}/held")
    assert held.count() == seen.get["dropped"] == seen.get["null_passenger_count"] > 0
    with pytest.raises(ValueError):
        load_trips(clean_trips(raw), dst, clean=False, account=Observation("x"))


# --- records ------------------------------------------------------------------------


def test_last_seen_type_of_each_field_wins(spark):
    rows = [
        (5, '{"a": "x", "b": null, "c": {"d": 1}}'), (1, '{"a": 1, "b": 2.5, "A": true}'), (2, '{"a": 1e3}'), (3, "[1, 2]"),
        (4, "{broken"), (6, None), (7, '"text"'), (8, "{}"), (9, '{"c": [1], "b": "late"}'), (10, '{"e.f": 12345678901234567890}'),
    ]
    df = spark.createDataFrame(rows, "record_no int, record string").repartition(3)
    whole = {r["column_name"]: (r["type_name"], r["seen"], r["types"]) for r in record_profile(df, sample_rows=None).collect()}
    assert whole == {
        "a": ("string", 3, "bigint,double,string"), "b": ("string", 3, "decimal,string,void"), "A": ("boolean", 1, "boolean"),
        "c": ("array", 2, "array,object"), "e.f": ("decimal", 1, "decimal"),
    }
    some = {r["column_name"]: r["type_name"] for r in record_profile(df, sample_rows=5).collect()}
    assert some == {"a": "string", "b": "void", "A": "boolean", "c": "object"}
    assert record_profile(df.limit(0)).collect() == []
