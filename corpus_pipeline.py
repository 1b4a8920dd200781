"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept:
quality classifier (what it rejects goes), exact dedup, SimHash near-dedup (one
document of each group stays), mixing sources to target weights (documents come
as often as the mix takes them), best-fit packing.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farewise.llm.common import land
from farewise.llm.exact_dedup import drop_exact_duplicates
from farewise.llm.mixing import mixed_rows
from farewise.llm.packing import pack_documents
from farewise.llm.quality import keep_quality
from farewise.llm.queries import tokenizer_path
from farewise.llm.simhash import drop_near_duplicates


# Python workers live from stage to stage, and their caches with them: a small one here,
# and less text that is tokenized at once.
CACHE_SPANS = 60_000
TEXT_AT_ONCE = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_path(), cache_spans=CACHE_SPANS, text_at_once=TEXT_AT_ONCE)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("best-fit packing", packing),
]

# Trained classifier, fingerprints and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = land(docs, f"stage-{i + 1}")
    return docs
