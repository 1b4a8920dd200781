"""Incremental load of the curated trip store with Structured Streaming.

The stream carries only the paths of the trip files landing in a folder.  Each
micro-batch reads its files with the batch reader (column case and types may
drift between them), cleans them and adds them to the store as one load, which
readers see once it is published.  The query's checkpoint remembers which files a
batch holds; a batch that is run again finds its name in the store, so every file is
in the store once, also after its load was compacted (``compact_store``).  Full and
incremental loads share one layout, and readers see both.

The checkpoint lies beside the store (``<target>_ingest``) unless another is
named: a later run goes on where the last one ended.  After a full refresh that
already holds the landed files, start with a checkpoint of your own choosing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from farewise.operators.clean import SOURCE_ZONE
from farewise.sources.trips import append_load, read_trip_files

MAX_FILES = 1000
# Fixed value: the columns of Spark's binary file source; only the path is read.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def start_trip_ingest(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    checkpoint_location: str | None = None,
    available_now: bool = True,
    poll: str = "1 minute",
    max_files_per_trigger: int = MAX_FILES,
    zone: str = SOURCE_ZONE,
    pattern: str = "*.parquet",
) -> StreamingQuery:
    """Start the incremental load; returns the running ``StreamingQuery``.
    ``max_files_per_trigger`` bounds each micro-batch, and with it the paths that
    reach the driver (``available_now`` still takes all files, in batches)."""
    checkpoint = checkpoint_location or f"{target_dir.rstrip('/')}_ingest"
    # loads of different checkpoints never share a name
    prefix = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex[:12]

    def add(files: DataFrame, batch: int) -> None:
        paths = [r["path"] for r in files.collect()]
        if paths:
            append_load(read_trip_files(spark, paths), target_dir, f"{prefix}-{batch}", zone)

    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir).select("path")
    )
    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=poll)
    return writer.start()
