"""Parquet files grouped by their schema, read from the footers by the tasks of one job."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_PER_TASK = 64
# Fixed value: the footer entry with the schema of files that Spark wrote.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the path in it, as pyarrow names them."""
    uri = re.sub(r"^file:/+", "/", path)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri)


def schema_key(path: str) -> str | None:
    """The columns and types of a file (of a folder: of its first file); None where it cannot be opened here."""
    try:
        system, at = _open(path)
        found = system.get_file_info(at)
        if found.type == pafs.FileType.Directory:
            inside = system.get_file_info(pafs.FileSelector(at, recursive=True))
            data = [i.path for i in inside if i.type == pafs.FileType.File and not re.match(r"[._]", i.base_name)]
            if not data:
                return None
            at = min(data)
        footer = pq.read_metadata(system.open_input_file(at))
    except (OSError, pa.ArrowException):
        return None
    columns = [
        (c.path, c.physical_type, str(c.logical_type), c.max_definition_level, c.max_repetition_level)
        for c in (footer.schema.column(i) for i in range(footer.num_columns))
    ]
    written = (footer.metadata or {}).get(SPARK_SCHEMA, b"").decode()
    return json.dumps([columns, written])


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``at`` (place in ``paths``) and ``key`` of each path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [schema_key(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string())], names=["at", "key"])

    rows = spark.createDataFrame(list(enumerate(paths)), "at long, path string")
    return rows.repartition(-(-len(paths) // FILES_PER_TASK), "at").mapInArrow(run, "at long, key string")


def files_by_schema(spark: SparkSession, paths: list[str]) -> tuple[list[list[str]], list[str]]:
    """Paths grouped by schema, in the order given, and those whose footers the tasks cannot open."""
    found = footers(spark, paths).groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("at")).collect()
    groups = sorted((r["at"] for r in found if r["key"] is not None), key=lambda at: at[0])
    return [[paths[i] for i in at] for at in groups], [paths[i] for r in found if r["key"] is None for i in r["at"]]
