"""Mixing sources to target weights: systematic sampling.

Sources in code-point order (null last) take the weights 5, 2, 1, repeating, and
share the words of all documents; a target stops at ``max_repeat`` times its
source's words, and the excess is shared again by weight until none is above.
That fixed point is ``target = min(max_repeat * words, level * weight)`` with one
``level`` for all, found by a few aggregates over the source table.

Within a source every document is expected ``target / words`` times.  With the
documents ordered by size, the prefix sum of expected copies plus one random
offset per source crosses an integer once per copy taken.  As the copies
lead or lag their expectation by less than one anywhere in that order, a
source's taken words differ from its target by less than its largest document.

Defined cases: null or empty text has size 0 and takes nothing; a null source is
a source of its own; repeated rows are rows of their own; a source without words
has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import attach, in_order, land, pick, position

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17
# Offsets are multiples of 2**-20, so adding them to whole copies stays exact.
OFFSET_STEPS = 1 << 20


def _level(sources: DataFrame, max_repeat: int) -> float:
    """The level at which capped targets sum to all words.  Each step caps the
    sources above the level of the step before; a few numbers reach the driver."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * float(max_repeat)
    while True:
        above = cap < F.col("weight") * F.lit(level)
        capped, open_weight = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        if not open_weight:
            return level
        nxt = (total - (capped or 0.0)) / open_weight
        if nxt <= level:
            return level
        level = nxt


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source of ``rows`` (no_source, source, size): n, source_size, start, target.
    ``start``: documents of the sources before it."""
    sums = rows.groupBy("no_source", "source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = in_order(sums, [F.col("no_source"), F.col("source")], "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    table = land(ranked.withColumn("weight", weight), "weights")
    level = _level(table, max_repeat)
    target = F.least(F.col("source_size") * float(max_repeat), F.col("weight") * F.lit(level))
    return table.select("no_source", "source", "n", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, keep: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.
    ``keep``: also a column ``row``, the input row's columns as a struct c0, c1, ..."""
    names = docs.columns
    whole = [F.struct(*[F.col(f"c{i}") for i in range(len(names))]).alias("row")] if keep else []
    base = docs.toDF(*[f"c{i}" for i in range(len(names))]) if keep else pick(docs, id=id_col, text=text_col, source=source_col)
    if keep:
        base = base.select(
            F.col(f"c{position(names, id_col)}").alias("id"), F.col(f"c{position(names, text_col)}").alias("text"),
            F.col(f"c{position(names, source_col)}").alias("source"), *whole,
        )
    rows = base.select(
        F.col("id").cast("long").alias("id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *(["row"] if keep else []),
    )
    rows = land(rows, "sizes")
    targets = land(source_targets(rows.drop("row"), weights, max_repeat), "targets")
    order = [F.col("no_source"), F.col("source"), F.col("size"), F.xxhash64(F.lit(seed), "id"), F.col("id")]
    placed = in_order(rows, order, "placed")
    # a source's rows are contiguous in that order: its first place by one count per source
    firsts = placed.groupBy("no_source", "source").agg(F.min("idx").alias("first"))
    table = targets.join(firsts, ["no_source", "source"])
    out = attach(placed, table, ["no_source", "source"], "n", rows.count())
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), "no_source", "source"), F.lit(OFFSET_STEPS)) / F.lit(float(OFFSET_STEPS))
    rank = F.col("idx") - F.col("first")
    crossed = F.floor(expected * (rank + 1) + offset) - F.floor(expected * rank + offset)
    copies = F.when(F.col("size") > 0, F.least(crossed, F.lit(max_repeat))).otherwise(0).cast("long")
    return out.withColumn("copies", copies).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if keep else []),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, once per copy."""
    picked = mix(docs, keep=True, **options).filter("copies > 0")
    copies = picked.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(f"row.c{i}").alias(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)
