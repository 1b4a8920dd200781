"""Exact dedup: tree-merge of sorted digest runs.

Every partition reduces its rows to one run, sorted by digest, of (digest,
smallest id, rows).  Partitions then exchange runs in rounds.  With the
partition number and the digest's home written in base ``radix``, round r sends
a run entry to the partner whose digit r is the digest's digit r; each partner
merges the runs it gets (multiway, streaming over sorted input) into one.  After
the last round every digest has one entry at its home.  A digest held by a third
of all rows is one entry per partition before the first round, and at most
``radix`` times fewer after each round, so no task ever sees its rows together.

An entry is keyed by SHA-256 and verified by a second, independent 64-bit hash:
entries merge only where both agree.

Defined cases: a null text counts as empty; a null id never becomes the keeper
unless every id of the group is null; of fully repeated rows (same id and text)
exactly one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farewise.llm.common import attach, land, lean, parts, pick, staying, text_of

RADIX = 8
WHITE = r"[\x20\x09-\x0D]+"
RUN = "part long, sha string, chk long, id long, n long"
ENTRY = pa.schema([("part", pa.int64()), ("sha", pa.string()), ("chk", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])


def normalised(text):
    """White-space runs become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of one partition, sorted by (part, sha, chk): adjacent equal keys become one."""
    keys, carry = ["part", "sha", "chk"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_arrays(batch.columns, schema=ENTRY)
        if carry is not None:
            table = pa.concat_tables([carry, table])
        out = table.group_by(keys, use_threads=False).aggregate([("id", "min"), ("n", "sum")])
        out = pa.Table.from_arrays(out.select([*keys, "id_min", "n_sum"]).columns, schema=ENTRY)
        if out.num_rows > 1:
            yield from out.slice(0, out.num_rows - 1).to_batches()
        carry = out.slice(max(0, out.num_rows - 1))
    if carry is not None:
        yield from carry.to_batches()


def _run(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions("part", "sha", "chk").mapInArrow(lean(_merge), RUN)


def merge_runs(digests: DataFrame, radix: int = RADIX) -> DataFrame:
    """One row per digest of ``digests`` (id, sha, chk): sha, chk, keep_id, group_size."""
    rounds = 1
    while radix**rounds < parts(digests):
        rounds += 1
    n = radix**rounds
    runs = _run(digests.select(
        F.pmod(F.spark_partition_id(), F.lit(n)).cast("long").alias("part"), "sha", "chk", "id", F.lit(1).cast("long").alias("n")
    ))
    home = F.pmod("chk", F.lit(n).cast("long"))
    for r in range(rounds):
        unit = radix**r
        digit = lambda c: F.floor(c / unit) % radix
        step = (digit(home) - digit(F.col("part"))) * unit
        runs = land(runs.withColumn("part", F.col("part") + step), "run")
        runs = _run(runs.repartition(n, "part"))
    return land(runs.select("sha", "chk", F.col("id").alias("keep_id"), F.col("n").alias("group_size")), "digests")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    text = normalised(F.col("text"))
    rows = land(
        pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text.alias("t")).select(
            "id", F.sha2("t", 256).alias("sha"), F.xxhash64("t", F.octet_length("t")).alias("chk")
        ),
        "digest-rows",
    )
    groups = merge_runs(rows)
    joined = attach(rows, groups, ["sha", "chk"], "group_size", rows.count())
    first = F.col("id").eqNullSafe(F.col("keep_id"))
    # only the keepers' own rows (one per digest, unless rows repeat) are numbered
    w = Window.partitionBy("sha", "chk", "id").orderBy("id")
    keepers = joined.filter(first).withColumn("kept", F.row_number().over(w) == 1)
    out = keepers.unionByName(joined.filter(~first).withColumn("kept", F.lit(False)))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select("doc_id", F.col("text_sha256").alias("key"))
    return staying(docs, kept, id_col, F.sha2(normalised(text_of(docs, text_col)), 256))
