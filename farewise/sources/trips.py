"""Trip sources and the curated trip store.

* ``read_trip_files``: many monthly Parquet files whose column case (and
  sometimes type) drifts between months.  Files are grouped by schema, each
  group is one scan, groups are lower-cased and unioned by name (types widen).
* ``positional_union``: the positional ``UNION ALL`` of several frames
  (first frame's names win), kept for frames that are known to line up.
* ``load_trips``: distributed refresh of the curated store, whole or by month.
* ``read_store``: the curated store, or any other format/connector.

The store (``farewise.sources.store``) is a set of published loads, each with folders
``pickup_month / pickup_hour``: a month reloads alone, a time of day prunes hours, and a
reader sees a load whole or not at all.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from farewise.operators.account import observed, quarantined
from farewise.operators.clean import SOURCE_ZONE, clean_trips, to_wall_clock
from farewise.sources import store
from farewise.sources.footers import files_by_schema
from farewise.sources.store import HOUR, LOAD, MONTH

FULL_LOAD, MONTHS_LOAD = "full", "months"
# Tasks that the trips of one hour of one month are split into.
HOUR_SPLITS = 16
SCHEMA_READERS = 16


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name.

    Columns whose names are equal up to case (a month carrying both
    ``Airport_fee`` and ``airport_fee``) are merged into one: the first non-null
    value in column order wins, and the type is their common type."""
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(df.columns):
        groups.setdefault(c.lower(), []).append(i)
    if all(len(g) == 1 for g in groups.values()):
        return df.toDF(*[c.lower() for c in df.columns])
    # positional renaming first: names equal up to case are ambiguous otherwise
    tmp = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    cols = [
        (F.col(f"_c{g[0]}") if len(g) == 1 else F.coalesce(*[F.col(f"_c{i}") for i in g])).alias(name)
        for name, g in groups.items()
    ]
    return tmp.select(*cols)


def positional_union(frames: list[DataFrame]) -> DataFrame:
    """``UNION ALL`` by position; duplicates kept, first frame's names win."""
    return reduce(DataFrame.union, frames)


def union_by_name(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames
    )


def _schema_of(spark: SparkSession, path: str, fmt: str) -> str:
    try:
        return spark.read.format(fmt).load(path).schema.json()
    except AnalysisException as e:
        if e.getCondition() == "COLUMN_ALREADY_EXISTS":
            raise ValueError(f"{path}: has columns whose names are equal up to case: {e.getMessageParameters()}") from e
        raise


def read_trip_files(
    spark: SparkSession, paths: list[str], fmt: str = "parquet", allow_missing: bool = False
) -> DataFrame:
    """All trip files as one lower-cased frame.

    Paths are grouped by their exact schema so that the usual case (every month
    alike) is a single scan over all files; only months that differ become
    separate scans in the union.  Parquet schemas come from the footers, read in one
    distributed job (``files_by_schema``): the driver makes one call per distinct
    schema, however many files there are.  Other formats, and file systems that only
    Spark opens, are looked at ``SCHEMA_READERS`` at a time.
    A file with two columns equal up to case is an error that names both."""
    if not paths:
        raise ValueError("no trip files given")
    groups, left = files_by_schema(spark, paths) if fmt == "parquet" else ([], list(paths))
    for group in groups:
        _schema_of(spark, group[0], fmt)
    if left:
        with ThreadPoolExecutor(SCHEMA_READERS) as pool:
            keys = list(pool.map(lambda p: _schema_of(spark, p, fmt), left))
        by_key: dict[str, list[str]] = {}
        for key, p in zip(keys, left):
            by_key.setdefault(key, []).append(p)
        groups = [*groups, *by_key.values()]
    frames = [normalize_columns(spark.read.format(fmt).load(group)) for group in groups]
    return union_by_name(frames, allow_missing)


def laid_out(curated: DataFrame, splits: int = HOUR_SPLITS) -> DataFrame:
    """Curated trips with their folders, each hour of a month split by a hash of
    the row over up to ``splits`` tasks (also without AQE), sorted by minute so
    a window filter skips row groups by their statistics."""
    share = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in curated.columns]), F.lit(splits))
    rows = curated.withColumns({MONTH: F.date_format("tpep_pickup_datetime", "yyyy-MM"), "_share": share})
    return rows.repartition(MONTH, HOUR, "_share").sortWithinPartitions(MONTH, HOUR, "pickup_minute").drop("_share")


def load_trips(
    trips: DataFrame,
    target: str,
    mode: str = "overwrite",
    clean: bool = True,
    zone: str = SOURCE_ZONE,
    splits: int = HOUR_SPLITS,
    account: Observation | None = None,
    quarantine: str | None = None,
) -> str:
    """Write trips (cleaned unless ``clean`` is False) to the curated store.

    ``mode="overwrite"`` replaces the store; ``mode="months"`` replaces only the
    months that ``trips`` has and leaves the others alone.  Either is one pass over
    ``trips``, and readers see the store before or after it, never between.

    ``account`` observes, during the load, how many rows came, were dropped, and for
    which column (``operators.account``); ``quarantine`` names a folder for the dropped
    rows with the columns that failed (written first, from a second pass)."""
    if mode not in ("overwrite", "months"):
        raise ValueError(f"mode must be 'overwrite' or 'months', got {mode!r}")
    if not clean and (account is not None or quarantine):
        raise ValueError("nothing is dropped from trips that are not cleaned")
    curated = trips
    if clean:
        local = to_wall_clock(normalize_columns(trips), zone)
        if quarantine:
            quarantined(local).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(quarantine)
        curated = clean_trips(observed(local, account) if account is not None else local, zone)
    rows = laid_out(curated, splits)
    spark = trips.sparkSession
    if mode == "overwrite":
        store.replace(spark, rows, target, FULL_LOAD)
    else:
        store.replace_months(spark, rows, target, MONTHS_LOAD)
    return target


def append_load(trips: DataFrame, target: str, load: str, zone: str = SOURCE_ZONE, splits: int = HOUR_SPLITS) -> bool:
    """Add trips to the store as the load ``load``; a load that the store has is not added again."""
    return store.add(trips.sparkSession, laid_out(clean_trips(normalize_columns(trips), zone), splits), target, load)


def compact_store(spark: SparkSession, target: str, small_bytes: int = store.SMALL_BYTES, splits: int = HOUR_SPLITS) -> int:
    """Merge the store's small loads (of the incremental load, say) into one; see ``store.compact``."""
    return store.compact(spark, target, lambda trips: laid_out(trips, splits), small_bytes)


def load_trip_files(
    spark: SparkSession, paths: list[str], target: str, fmt: str = "parquet"
) -> str:
    """First-time set-up from a list of monthly files: read them all (case
    drift handled), clean, and replace the curated store at ``target``."""
    return load_trips(read_trip_files(spark, paths, fmt), target, mode="overwrite")


def read_store(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """The stored trips.  The default is the newest published version of the curated
    Parquet store (without the folder columns that are not trip data), or a plain
    Parquet folder; a document-store or any other connector is only another
    ``fmt``/``options``."""
    if fmt == "parquet" and path is not None and not options:
        now = store.published(spark, path)
        if now:
            return store.read_loads(spark, path, now[1])
    reader = spark.read.format(fmt).options(**options)
    stored = reader.load(path) if path is not None else reader.load()
    return stored.drop(MONTH, LOAD) if fmt == "parquet" else stored
