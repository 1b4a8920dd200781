"""Hard-negative mining with exact integer scores from a residue-number-system GEMM.

Components are integers (floor(256 * x)).  Their inner products are exact although
every multiplication runs in float32:

* the components modulo several primes below 256, centred on zero, are float32
  matrices with entries of at most 127; over at most ``DEPTH`` components a product
  sums to less than 2**24, which float32 holds exactly;
* one matrix product per prime, taken modulo the prime, gives the residues of all
  scores of a tile; Chinese remaindering (mixed radix, int64) gives the signed
  scores back.  ``primes_for`` takes as many primes as twice the largest possible
  |score| needs (Cauchy-Schwarz over the longest vector of each side).

Anchors are the stated query set (``vec_id`` divisible by ``every``), against all
rows, in blocks of at most ``BLOCK_BYTES``: a block is broadcast, each task scores
the rows it reads against it tile by tile and keeps the best of each anchor.  Two
passes per block: the first finds the anchor's nearest rows of its label, whose
scores set the windows; the second takes the best rows of other labels inside each
window.  A block keeps every core of the cluster at work (anchors of one block x
all rows), so the blocks follow one another.  Rows are never dealt by label: a
label may hold any share of them.

Defined cases: rows with a null id, label or vector, or with a null, NaN or infinite
component take no part; a shorter vector counts as filled up with zeros; repeated
rows are rows of their own (an anchor's twin can be its positive); equal scores
come by smaller id; an anchor without other rows of its label, or without rows in
the window, gives nothing; an empty table gives an empty result.  Scores of which
100 times could pass 64 bits are refused (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farewise.llm.common import land, pick, union_all

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
#: Per cent of the positive score that a negative's score lies between.
WINDOW = (30, 90)
#: Components that one float32 product sums: 127 * 127 * DEPTH < 2**24.
DEPTH = 1024
#: Rows scored at once against a block, and the bytes of a broadcast block of anchors.
TILE_ROWS = 2048
TILE_CELLS = 1 << 21
BLOCK_BYTES = 8 << 20
#: Before the score that a list needs is known.
LOWEST = -(1 << 62)

ROWS_SCHEMA = "row long, vec_id long, label int, v array<long>"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def primes_for(bound: int) -> list[int]:
    """The largest primes below 256 whose product exceeds ``2 * bound``."""
    primes = [p for p in range(255, 2, -1) if all(p % q for q in range(2, int(p ** 0.5) + 1))]
    chosen: list[int] = []
    while prod(chosen) <= 2 * bound:
        chosen.append(primes[len(chosen)])
    return chosen


def residues(v: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """``v`` (integers) modulo each prime, centred on zero, as float32."""
    return [((v + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def gemm(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact signed products of rows of ``left`` with rows of ``right``."""
    total = None
    radix = 1
    for p, a, b in zip(primes, left, right):
        r = np.zeros((a.shape[0], b.shape[0]), dtype=np.int64)
        for i in range(0, a.shape[1], DEPTH):
            r += (a[:, i:i + DEPTH] @ b[:, i:i + DEPTH].T).astype(np.int64)
        if total is None:
            total = r % p
        else:
            # the digit of this prime in the mixed radix
            total += radix * ((r - total) % p * pow(radix, -1, p) % p)
        radix *= p
    return np.where(total > radix // 2, total - radix, total)


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
              scale: int = SCALE) -> DataFrame:
    """The rows that take part: row (their number), vec_id, label, v (integers)."""
    some = pick(rows, vec_id=id_col, e=vector_col, label=label_col)
    x = some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("e").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~bad)
    return ok.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("e", lambda c: F.floor(c * scale)).alias("v")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers, short ones filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Block:
    """Anchors that are sent to all tasks together."""

    def __init__(self, table: pa.Table, width: int, primes: list[int]):
        self.rows, self.ids, self.labels = (table.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.parts = residues(_matrix(table.column("v").combine_chunks(), width), primes)
        self.width, self.primes = width, primes

    def tiles(self, batches: Iterator[pa.RecordBatch]):
        """(rows, ids, labels, scores of all anchors) of the rows read, some at a time."""
        step = max(1, min(TILE_ROWS, TILE_CELLS // max(len(self.ids), self.width, 1)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                some = batch.slice(i, step)
                parts = residues(_matrix(some.column(3), self.width), self.primes)
                yield (*(some.column(c).to_numpy() for c in range(3)), gemm(self.parts, parts, self.primes))


class Best:
    """The best ``k`` (score, then smaller id) of each of many lists."""

    def __init__(self, lists: int, k: int):
        self.k, self.least = k, np.full(lists, LOWEST)
        self.of, self.ids, self.scores = (np.empty(0, dtype=np.int64) for _ in range(3))

    def add(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        of, ids, scores = (np.concatenate(x) for x in ((self.of, of), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        starts = np.searchsorted(of, of)
        keep = np.arange(len(of)) - starts < self.k
        self.of, self.ids, self.scores = of[keep], ids[keep], scores[keep]
        counts = np.bincount(self.of, minlength=len(self.least))
        full = counts >= self.k
        self.least[full] = self.scores[(np.cumsum(counts) - 1)[full]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        if len(self.of):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.of, self.ids, self.scores)], names=["of", "id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each list over all tasks."""
    w = Window.partitionBy("of").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        best = Best(len(anchors.ids), k)
        for rows, ids, labels, scores in anchors.tiles(batches):
            fits = (labels == anchors.labels[:, None]) & (rows != anchors.rows[:, None]) & (scores >= best.least[:, None])
            a, r = np.nonzero(fits)
            if len(a):
                best.add(a, ids[r], scores[a, r])
        yield from best.batches()

    return run


def _inside(block, windows, k: int, share: tuple[int, int]):
    """``windows``: (anchor, positive's score) per list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (of, positive) = block.value, windows.value
        best = Best(len(of), k)
        low, high = -(-share[0] * positive // 100), share[1] * positive // 100
        # the lists of anchors by the place of the positive: one tile of scores serves each
        place = np.arange(len(of)) - np.searchsorted(of, of)
        groups = [np.flatnonzero(place == i) for i in range(place.max() + 1)] if len(of) else []
        for _, ids, labels, scores in anchors.tiles(batches):
            other = labels != anchors.labels[:, None]
            for lists in groups:
                mine = scores[of[lists]]
                least = np.maximum(low[lists], best.least[lists])
                fits = other[of[lists]] & (mine >= least[:, None]) & (mine <= high[lists][:, None])
                a, r = np.nonzero(fits)
                if len(a):
                    best.add(lists[a], ids[r], mine[a, r])
        yield from best.batches()

    return run


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = ANCHOR_EVERY,
         window: tuple[int, int] = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hard negatives of every anchor in ``rows`` (columns of ``quantised``)."""
    spark = rows.sparkSession
    rows = land(rows.select("row", "vec_id", "label", "v"), "vectors")
    norm = F.aggregate(F.transform("v", lambda c: c.cast("double") * c), F.lit(0.0), lambda a, b: a + b)
    width, longest, n = rows.agg(
        F.max(F.size("v")), F.max(norm), F.count(F.when(F.col("vec_id") % every == 0, 1))
    ).first()
    empty = spark.createDataFrame([], MINED)
    if not n:
        return empty
    bound = int(longest * 1.000001) + 1
    if bound * 100 >= 1 << 63:
        raise ValueError(f"scores of up to {bound} are beyond 64-bit windows")
    width, primes = max(width, 1), primes_for(bound)
    blocks = -(-n * (width * (8 + 4 * len(primes)) + 64) // block_bytes)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    mined = []
    for i in range(blocks):
        # about block_bytes of anchors pass the driver at a time
        some = Block(anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).toArrow(), width, primes)
        if not len(some.ids):
            continue
        block = spark.sparkContext.broadcast(some)
        near = _best(rows.mapInArrow(_nearest(block, positives), "of long, id long, score long"), positives).toArrow()
        of, ids, scores = (near.column(c).to_numpy() for c in ("of", "id", "score"))
        order = np.lexsort((near.column("rank").to_numpy(), of))
        of, ids, scores = of[order], ids[order], scores[order]
        windows = spark.sparkContext.broadcast((of, scores))
        inside = _best(rows.mapInArrow(_inside(block, windows, negatives, window), "of long, id long, score long"), negatives)
        # at most ``positives`` rows per anchor of the block
        lists = spark.createDataFrame(
            pa.table({"of": np.arange(len(of)), "anchor_id": some.ids[of], "positive_id": ids, "positive_score": scores}),
        )
        mined.append(land(inside.join(F.broadcast(lists), "of").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        ), "negatives"))
        block.unpersist()
        windows.unpersist()
    return union_all(mined) if mined else empty


def hard_negatives(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   relabel_every: int = 7, labels: int = 10, **options) -> DataFrame:
    """``mine`` over quantised rows, the label of every ``relabel_every``-th id moved on by one (modulo ``labels``)."""
    rows = quantised(embeddings, id_col, vector_col, label_col)
    moved = F.when(F.col("vec_id") % relabel_every == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved.cast("int")), **options)
