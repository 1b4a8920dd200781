"""Schema inspection and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_profile(df: DataFrame, sample_rows: int = 10) -> DataFrame:
    """``(column_name, type_name)`` observed on a sample of ``sample_rows`` rows
    (the sample size is the feature: a profile of a few records).

    The sample is taken with ``take``, which scans partitions incrementally
    (one first, more only if needed), so profiling a huge table opens a few
    file splits instead of one task per split; at most ``sample_rows`` rows
    reach the driver."""
    sample = df.sparkSession.createDataFrame(df.take(sample_rows), df.schema)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.typeof(F.col(f"`{c}`")).alias("type_name"))
            for c in df.columns
        ]
    )
    return sample.select(F.explode(pairs).alias("p")).select("p.column_name", "p.type_name").distinct()


def record_profile(records: DataFrame, record: str = "record", order_by: str = "record_no", sample_rows: int | None = 10) -> DataFrame:
    """``column_name, type_name, seen, types`` of schemaless records, each a JSON text.

    Every record is looked at by itself (as a VARIANT): a field's ``type_name`` is that of the
    last record, by ``order_by``, that has it; ``seen`` counts the records with it and ``types``
    lists all its types in alphabetical order, so drifting fields stand out.  Types are those of
    VARIANT without their parameters (bigint, decimal, double, string, boolean, void, object, array, ...).

    ``sample_rows`` takes the first records by ``order_by`` (the sample is the feature); None
    profiles all of them in one pass, a partial row per field and task being shuffled.
    Records that are null, malformed or no object are passed over."""
    some = records.select(F.col(order_by).alias("_at"), F.col(record).alias("_record"))
    if sample_rows is not None:
        some = some.orderBy("_at").limit(sample_rows)
    parsed = some.select("_at", F.try_parse_json("_record").alias("_v"))
    objects = parsed.filter(F.schema_of_variant("_v").startswith("OBJECT"))
    fields = objects.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    kind = F.lower(F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0))
    return fields.select(F.col("key").alias("column_name"), "_at", kind.alias("_type")).groupBy("column_name").agg(
        F.max_by("_type", "_at").alias("type_name"), F.count(F.lit(1)).alias("seen"),
        F.array_join(F.sort_array(F.collect_set("_type")), ",").alias("types"),
    )


def schema_text(df: DataFrame) -> str:
    """The tree ``printSchema`` prints, as a string."""
    return df.schema.treeString()


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, ordered by ``order_by`` so the preview is repeatable."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)
