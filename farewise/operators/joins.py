"""Dimension joins.

One plan at every size: the join is left to Spark, which broadcasts a side by
its byte size (``spark.sql.autoBroadcastJoinThreshold``) and otherwise shuffles,
with AQE splitting skewed partitions.  Where one key holds a large share of the
facts and AQE is off, ``salt_buckets`` splits it explicitly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOIN_TYPES = ("inner", "left")


def check_join_type(how: str) -> str:
    """Only joins that keep or drop facts: dimension rows without a fact are
    never part of an answer (a salted side would repeat them)."""
    if how not in JOIN_TYPES:
        raise ValueError(f"how must be one of {JOIN_TYPES}, got {how!r}")
    return how


def join_dimension(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "left",
    salt_buckets: int | None = None,
) -> DataFrame:
    """``fact`` joined to ``dim`` on ``fact_key = dim_key``; the key of ``dim`` is dropped."""
    check_join_type(how)
    if salt_buckets:
        return salted_join(fact, dim, fact_key, dim_key, how, salt_buckets)
    return fact.join(dim, fact[fact_key] == dim[dim_key], how).drop(dim[dim_key])


def salted_join(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str, buckets: int
) -> DataFrame:
    """Shuffle equi-join that splits hot keys: every fact row gets a salt in
    ``[0, buckets)`` from a hash of its own columns (deterministic, so a retried
    task sends each row to the same place), and each dimension row is repeated
    once per salt.  A key holding a third of the facts is spread over
    ``buckets`` reducers; each fact row still meets exactly one copy of each
    matching dimension row, so inner and left joins are unchanged."""
    check_join_type(how)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in fact.columns]), F.lit(buckets)).cast("int")
    f = fact.withColumn("_salt", salt)
    d = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    joined = f.join(d, (f[fact_key] == d[dim_key]) & (f["_salt"] == d["_salt"]), how)
    return joined.drop(f["_salt"]).drop(d["_salt"]).drop(d[dim_key])
