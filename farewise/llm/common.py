"""Helpers shared by the operators: column picking, landed tables, global order,
and a join that survives hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.session import scratch_path

# A key holding at least 1/HOT_SHARE of the rows is hot, so there are at most
# HOT_SHARE of them: the bound on what ``attach`` broadcasts.
HOT_SHARE = 1000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` reduced to ``new_name=old_name`` columns.

    Works by position, so extra columns whose names clash (also up to case, or
    outright repeated) do no harm: an exact match wins over a match up to case,
    the first of several over the later ones.  A missing column raises KeyError.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{position(names, old)}").alias(new) for new, old in columns.items()])


def position(names: list[str], wanted: str) -> int:
    """Index of the column ``wanted``: exact name first, then up to case."""
    for fold in (str, str.lower):
        for i, name in enumerate(names):
            if fold(name) == fold(wanted):
                return i
    raise KeyError(f"no column {wanted!r} among {names}")


def land(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage (a lost executor re-reads files instead of replaying the
    plan) and freezes values that depend on the partitioning."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """The session's shuffle partition count."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` landed with ``idx``, the row's place (from 0) in the global ``order``.

    Range partitioning and a local sort; a row's place is its place in its
    partition plus the rows of the partitions before.  Only one count per
    partition reaches the driver, however skewed the keys are."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = land(sorted_.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    spark = df.sparkSession
    # one row per partition: bounded by the partition count
    table = spark.createDataFrame(starts, "p long, before long")
    return (
        placed.join(F.broadcast(table), part == table["p"])
        .withColumn("idx", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("p", "before", "_at")
    )


def attach(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined to ``table`` (one row per key; ``count``: rows with that key).

    Keys holding at least a 1/HOT_SHARE share of all ``total`` rows are at most
    HOT_SHARE in number and join map-side from a broadcast; the other keys are
    shuffled, and none of those is large.  Keys must not be null."""
    hot = table.filter(F.col(count) * HOT_SHARE >= total)
    cold = table.filter(F.col(count) * HOT_SHARE < total)
    marks = hot.select(*keys).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(marks), keys, "left")
    return (
        marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot), keys)
        .unionByName(marked.filter(F.col("_hot").isNull()).drop("_hot").hint("merge").join(cold, keys))
    )


def give_back() -> None:
    """Returns to the system the memory that this process has freed but still holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(per_batch: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``per_batch`` for ``mapInArrow``, giving memory back when its task ends: Python workers
    live on beside the executor, and what a task has freed would stay with them."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from per_batch(batches)
        finally:
            give_back()

    return run


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_of(docs: DataFrame, text_col: str) -> Column:
    """The text column under the positional names (c0, c1, ...) that ``staying`` uses."""
    return F.col(f"c{position(docs.columns, text_col)}")


def staying(docs: DataFrame, kept: DataFrame, id_col: str, key: Column) -> DataFrame:
    """One row of ``docs`` for each (doc_id, key) in ``kept``, with all its columns.
    ``key``: an expression over positional names; it tells rows with one id apart."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def keyed(df, id_):
        return df.withColumns({"_i": F.coalesce(id_.cast("long"), F.lit(0)), "_n": id_.isNull()})

    rows = keyed(plain.withColumn("_k", key), F.col(f"c{position(names, id_col)}"))
    marks = keyed(kept.withColumnRenamed("key", "_k"), F.col("doc_id")).select("_i", "_n", "_k").distinct()
    on = ["_i", "_n", "_k"]
    # the keys of the join are those of the second step: no further shuffle
    return rows.join(marks, on, "left_semi").dropDuplicates(on).select(*plain.columns).toDF(*names)
