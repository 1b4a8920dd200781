"""The curated trip store as published loads.

``<store>/load=<folder>/pickup_month=.../pickup_hour=...`` holds the trips,
``<store>/_published/version=<n>`` one record of which loads make up version ``n``.

A load is written into a folder of its own and becomes visible by one record that is
written when it is complete; a reader resolves the newest record and reads just its
loads.  A load that dies midway leaves a folder that no record names: readers see the
version before, whole.  Nothing that is published is ever changed, so a reader that has
resolved a version goes on reading it; ``vacuum`` removes what no version of the last
``keep_hours`` names.  Versions are claimed by creating their folder, so of two writers
at once one fails (``StoreChanged``) and runs again.

Loads that replace single months hide these months of the loads before them.  Batches of
the incremental load carry a name; a name that is in the store, also within a compacted
load, is not loaded again, so a batch that runs twice is in the store once.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH, HOUR, LOAD = "pickup_month", "pickup_hour", "load"
FOLDERS = (MONTH, HOUR)
PUBLISHED = "_published"
RECORD = "published_at timestamp, loads string"
KEEP_HOURS = 24 * 7
SMALL_BYTES = 1 << 30


class StoreChanged(RuntimeError):
    """Another writer published in between."""


@dataclass
class Load:
    """One folder of the store: the names it holds, its columns, and months that later loads replaced."""

    folder: str
    names: list[str]
    schema: str
    hidden: list[str] = field(default_factory=list)


def _base(target: str) -> str:
    return target.rstrip("/")


def published(spark: SparkSession, target: str) -> tuple[int, list[Load]] | None:
    """The newest version and its loads, or None where nothing was ever published."""
    try:
        records = spark.read.schema(f"{RECORD}, version long").json(f"{_base(target)}/{PUBLISHED}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    newest = records.filter(F.col("loads").isNotNull()).orderBy(F.desc("version")).limit(1).collect()
    return (newest[0]["version"], [Load(**x) for x in json.loads(newest[0]["loads"])]) if newest else None


def publish(spark: SparkSession, target: str, after: int, loads: list[Load]) -> int:
    """Make ``loads`` the store, provided that ``after`` is still its newest version."""
    record = spark.createDataFrame([(json.dumps([asdict(x) for x in loads]),)], "loads string")
    version = after + 1
    path = f"{_base(target)}/{PUBLISHED}/version={version}"
    try:
        record.select(F.current_timestamp().alias("published_at"), "loads").coalesce(1).write.mode("errorifexists").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise StoreChanged(f"{target}: version {version} was published by another writer") from e
        raise
    return version


def write_load(rows: DataFrame, target: str, name: str) -> Load:
    """Write ``rows`` (with their folder columns) to a new folder; nobody sees it before it is published."""
    folder = f"{name}-{uuid.uuid4().hex[:12]}"
    # a fresh folder: no session setting can mix it with older files
    rows.write.mode("errorifexists").partitionBy(*FOLDERS).parquet(f"{_base(target)}/{LOAD}={folder}")
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    return Load(folder, [name], plain.json())


def read_loads(spark: SparkSession, target: str, loads: list[Load]) -> DataFrame:
    """The trips of some loads, without the folder columns that are not trip data.

    One scan for each distinct set of columns; footers are not opened."""
    by_schema: dict[str, list[Load]] = {}
    for x in loads:
        by_schema.setdefault(x.schema, []).append(x)
    frames = []
    for schema, group in by_schema.items():
        fields = T.StructType.fromJson(json.loads(schema)).add(LOAD, T.StringType())
        paths = [f"{_base(target)}/{LOAD}={x.folder}" for x in group]
        rows = spark.read.schema(fields).option("basePath", _base(target)).parquet(*paths)
        for x in group:
            if x.hidden:
                rows = rows.filter(~((F.col(LOAD) == x.folder) & F.col(MONTH).isin(x.hidden)))
        frames.append(rows.drop(MONTH, LOAD))
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def replace(spark: SparkSession, rows: DataFrame, target: str, name: str) -> None:
    """``rows`` become the whole store."""
    new = write_load(rows, target, name)
    now = published(spark, target)
    publish(spark, target, now[0] if now else 0, [new])


def replace_months(spark: SparkSession, rows: DataFrame, target: str, name: str) -> None:
    """``rows`` replace the months they have, the other months stay: one pass over ``rows``."""
    new = write_load(rows, target, name)
    fields = T.StructType.fromJson(json.loads(new.schema))
    months = spark.read.schema(fields).parquet(f"{_base(target)}/{LOAD}={new.folder}").select(MONTH).distinct()
    named = sorted(r[0] for r in months.collect())  # one row per month of the reload
    version, loads = published(spark, target) or (0, [])
    for x in loads:
        x.hidden = sorted({*x.hidden, *named})
    publish(spark, target, version, [*loads, new])


def add(spark: SparkSession, rows: DataFrame, target: str, name: str) -> bool:
    """Add ``rows`` as the load ``name``; False (and nothing done) where the store has that name."""
    now = published(spark, target)
    if now and any(name in x.names for x in now[1]):
        return False
    new = write_load(rows, target, name)
    version, loads = published(spark, target) or (0, [])
    publish(spark, target, version, [*loads, new])
    return True


def load_sizes(spark: SparkSession, target: str) -> DataFrame:
    """``load, files, bytes`` of every folder in the store, published or not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    found = files.load(f"{_base(target)}/{LOAD}=*").select(F.regexp_extract("path", rf"/{LOAD}=([^/]+)/", 1).alias(LOAD), "length")
    return found.groupBy(LOAD).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def compact(spark: SparkSession, target: str, layout, small_bytes: int = SMALL_BYTES) -> int:
    """Rewrite the published loads of less than ``small_bytes`` as one; returns how many were merged.

    ``layout``: puts trips in the store's order (see ``trips.laid_out``).  The names of the
    merged loads go into the new one.  Batches may be added meanwhile; a load that was
    merged and has changed since (a month replaced) makes it fail, and it can run again."""
    now = published(spark, target)
    if not now or len(now[1]) < 2:
        return 0
    sizes = {r[LOAD]: r["bytes"] for r in load_sizes(spark, target).collect()}  # one row per load
    small = [x for x in now[1] if sizes.get(x.folder, 0) < small_bytes]
    if len(small) < 2:
        return 0
    new = write_load(layout(read_loads(spark, target, small)), target, "compacted")
    new.names = sorted({n for x in small for n in x.names})
    version, loads = published(spark, target)
    merged = {x.folder for x in small}
    if [x for x in loads if x.folder in merged] != small:
        raise StoreChanged(f"{target}: a load was replaced while it was compacted")
    publish(spark, target, version, [*[x for x in loads if x.folder not in merged], new])
    return len(small)


def vacuum(spark: SparkSession, target: str, keep_hours: float = KEEP_HOURS) -> list[str]:
    """Delete the loads that no version of the last ``keep_hours`` (nor the newest) names, and the
    records of older versions; returns the deleted folders.  Loads under way must be younger
    than ``keep_hours``: a folder is only deleted once all its files are older."""
    now = published(spark, target)
    if not now:
        return []
    limit = F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(keep_hours) * 3600))
    records = spark.read.schema(f"{RECORD}, version long").json(f"{_base(target)}/{PUBLISHED}").filter(F.col("loads").isNotNull())
    # a version was in force until the next one
    kept = [r for r in records.select("version", "loads", (F.col("published_at") >= limit).alias("young")).collect()]
    ordered = sorted(kept, key=lambda r: r["version"])
    live = [r for i, r in enumerate(ordered) if i + 1 == len(ordered) or ordered[i + 1]["young"]]
    named = {x["folder"] for r in live for x in json.loads(r["loads"])}
    ages = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{_base(target)}/{LOAD}=*").groupBy(
        F.regexp_extract("path", rf"/{LOAD}=([^/]+)/", 1).alias(LOAD)
    ).agg((F.max("modificationTime") < limit).alias("old"))
    gone = sorted(r[LOAD] for r in ages.collect() if r["old"] and r[LOAD] not in named)
    dead = [f"{LOAD}={x}" for x in gone]
    dead += [f"{PUBLISHED}/version={r['version']}" for r in ordered if r not in live]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in dead:
        path = jvm.org.apache.hadoop.fs.Path(f"{_base(target)}/{x}")
        path.getFileSystem(conf).delete(path, True)
    return gone
