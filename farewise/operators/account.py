"""An account of the rows that cleaning drops: how many, for which column, and which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, DROPPED = "rows", "dropped"


def _failing(df: DataFrame) -> dict[str, Column]:
    """Per column whether it makes a row incomplete, as ``drop_incomplete`` sees it."""
    out = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        out[f.name] = c.isNull() | F.isnan(c) if number else c.isNull()
    return out


def _any(failing: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in failing.values():
        out = out | c
    return out


def observed(df: DataFrame, account: Observation) -> DataFrame:
    """``df``, with ``account`` filled by the job that reads it: ``rows``, ``dropped`` and
    ``null_<column>`` (rows in which that column is null or NaN).  No pass of its own."""
    failing = _failing(df)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return df.observe(
        account, F.count(F.lit(1)).alias(ROWS), count(_any(failing)).alias(DROPPED),
        *[count(c).alias(f"null_{name}") for name, c in failing.items()],
    )


def drop_account(df: DataFrame) -> DataFrame:
    """``column_name, failing``: rows in which the column is null or NaN; the row without a name
    counts the rows that are dropped for any of them.  One pass, one row of partial sums a task."""
    failing = _failing(df)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    sums = df.agg(*[count(c).alias(f"f{i}") for i, c in enumerate([*failing.values(), _any(failing)])])
    pairs = [F.struct(F.lit(n).cast("string").alias("column_name"), F.col(f"f{i}").alias("failing")) for i, n in enumerate([*failing, None])]
    return sums.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def quarantined(df: DataFrame) -> DataFrame:
    """The rows that cleaning drops, with ``failing``: the names of their null or NaN columns."""
    failing = _failing(df)
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in failing.items()]), lambda n: n.isNotNull())
    return df.filter(_any(failing)).withColumn("failing", names)
