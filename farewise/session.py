"""Session-level helpers: checkpoint directory and reliable lineage cuts.

The library never creates a session.  It reads ``spark.checkpoint.dir`` from the
caller's session and raises where a step needs it and it is unset.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, or None."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        return spark.conf.get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; set it to a folder every executor can reach"
        )
    return f"{base.rstrip('/')}/farewise/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to reliable storage so a lost executor does not
    replay the plan that produced it.  Used for tables bounded by a dimension
    or a parameter: per-zone-point statistics ahead of k-means, the k-row
    cluster table.  With ``spark.cleaner.referenceTracking.cleanCheckpoints``
    Spark deletes the files once the result is no longer referenced."""
    if not checkpoint_dir(df.sparkSession):
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; set it to a folder every executor can reach"
        )
    return df.checkpoint(eager=True)
