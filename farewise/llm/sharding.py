"""Sharding: minimax contiguous partition.

Rows with equal texts form one atomic group.  Groups are ordered by the 64-bit
hash of their text; a shard is a contiguous stretch of that order.  The smallest
capacity for which greedy filling needs no more than ``shards`` shards is found
by binary search, and the cuts are made at that capacity.

The driver never holds the groups.  It holds the byte totals of at most a few
times ``CELLS`` cells, each a stretch of the order; groups larger than a
1/CELLS share are cells of their own.  Taking cells as atomic gives a feasible
capacity, the mean and the largest group give a lower bound, and together they
confine every cut to a short stretch.  Only the cells in those stretches are
split further, in one pass over the groups each time, until a cut can only fall
between single groups: then the capacity is the exact minimum.  Among the cuts
that meet it, those nearest to equal shares are taken.

Defined cases: a null text has size 1 and is grouped with empty texts; rows with
equal texts share a shard; fewer groups than shards leave shards empty; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import in_order, land, pick

CELLS = 1 << 16
SHARDS = 16
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _cell_sums(groups: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and groups of each cell [bounds[i], bounds[i + 1])."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(bounds, b.column("key").to_numpy(), side="right") - 1
            cells, where = np.unique(at, return_inverse=True)
            sums = np.zeros(len(cells), dtype=np.int64)
            np.add.at(sums, where, b.column("bytes").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(sums), pa.array(np.bincount(where, minlength=len(cells)).astype(np.int64))],
                names=["cell", "bytes", "n"],
            )

    got = (
        groups.select("key", "bytes").mapInArrow(per_batch, "cell long, bytes long, n long")
        .groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).toPandas()
    )
    size, n = np.zeros(len(bounds), dtype=np.int64), np.zeros(len(bounds), dtype=np.int64)
    size[got["cell"]], n[got["cell"]] = got["bytes"], got["n"]
    return size, n


def greedy(prefix: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Ends (cells taken so far) after filling each shard up to ``capacity``; prefix[i]: bytes of the first i cells."""
    ends, at = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        ends.append(at)
    return ends


def smallest_capacity(prefix: np.ndarray, shards: int, low: int) -> int:
    """The smallest capacity, ``low`` at least, with which greedy filling takes every cell."""
    high = max(low, int(prefix[-1]))
    while low < high:
        mid = (low + high) // 2
        if greedy(prefix, mid, shards)[-1] == len(prefix) - 1:
            high = mid
        else:
            low = mid + 1
    return low


def balanced_cuts(prefix: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts (cells before each of the shards 1, 2, ...) within ``capacity``, as near to equal shares as that allows."""
    total, last = prefix[-1], len(prefix) - 1
    earliest = [0] * (shards + 1)  # the rest fits the shards that follow
    earliest[shards] = last
    for k in range(shards - 1, 0, -1):
        earliest[k] = int(np.searchsorted(prefix, prefix[earliest[k + 1]] - capacity, side="left"))
    cuts, at = [], 0
    for k in range(1, shards):
        latest = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        share = total * k / shards
        near = int(np.searchsorted(prefix, share, side="left"))
        if 0 < near <= last and share - prefix[near - 1] <= prefix[near] - share:
            near -= 1
        at = max(at, min(max(near, earliest[k]), latest))
        cuts.append(at)
    return cuts


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> tuple[list[int], int]:
    """First key of each of the shards 1, 2, ... and the capacity.  ``groups``: key, bytes."""
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    if not total:
        return [HIGH] * (shards - 1), 0
    # fewer than ``cells`` groups are larger than a 1/cells share
    big = [r[0] for r in groups.filter(F.col("bytes") > total / cells).select("key").collect()]
    edges = {LOW + i * ((1 << 64) // cells) for i in range(cells)}
    edges.update(big, (k + 1 for k in big if k < HIGH))
    bounds = np.array(sorted(edges), dtype=np.int64)
    low = max(-(-total // shards), largest)
    while True:
        size, n = _cell_sums(groups, bounds)
        prefix = np.concatenate([[0], np.cumsum(size)])
        capacity = smallest_capacity(prefix, shards, low)
        behind, reach, active = greedy(prefix, low, shards), 0, np.zeros(len(bounds), dtype=bool)
        for k in range(shards):
            ahead = min(int(np.searchsorted(prefix, prefix[reach] + capacity, side="left")), len(bounds))
            active[behind[k]: ahead + 1] = True
            reach = ahead
        split = np.flatnonzero(active & (n > 1))
        if not len(split) or capacity == low:
            break
        ways = max(2, cells // len(split))
        more = []
        for i in split:
            first = int(bounds[i])
            last = int(bounds[i + 1]) if i + 1 < len(bounds) else HIGH
            step = max(1, (last - first) // ways)
            more.extend(range(first + step, last, step))
        bounds = np.unique(np.concatenate([bounds, np.array(more, dtype=np.int64)]))
    cuts = balanced_cuts(prefix, capacity, shards)
    return [int(bounds[c]) if c < len(bounds) else HIGH for c in cuts], capacity


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = land(
        pick(docs, id=id_col, text=text_col).select(
            F.col("id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-rows",
    )
    groups = land(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    cuts, _ = minimax_cuts(groups, shards)
    number = sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    order = [F.col("shard"), F.col("key"), F.col("doc_id")]
    placed = in_order(rows.withColumn("shard", number.cast("int")), order, "shard-order")
    firsts = dict(tuple(r) for r in placed.groupBy("shard").agg(F.min("idx")).collect())  # one row per shard
    first = F.element_at(F.create_map(*[F.lit(x) for kv in (firsts or {0: 0}).items() for x in kv]), F.col("shard"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("idx") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
