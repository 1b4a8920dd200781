"""Tables with everything an operator must survive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 700}" for i in range(30_000))

ROWS = [
    (1, "Licensed under the Apache License, Version 2.0. and more words follow here", "en", "a", 10),
    (2, "the same text", "en", "a", 13),
    (3, "the  same\ttext", "en", None, 13),
    (4, "the same text", None, "b", None),
    (4, "the same text", None, "b", None),  # a repeated row
    (5, None, None, None, None),
    (6, "", "fr", "c", 0),
    (None, "a text without an id", "en", "a", 20),
    (7, LONG, "en", "a", len(LONG)),
    (20, "the same text again <|endoftext|> été  ½\n\n x.", "en", "é", 5),
    (40, " \t\n ", "en", "", 4),
    (60, "one", "en", "b", 3),
]

# extra columns whose names clash, up to case and outright
SCHEMA = T.StructType(
    [
        T.StructField("Text", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("size", T.StringType()),
    ]
)


def edge_docs(spark: SparkSession) -> DataFrame:
    rows = [("WRONG", *r, "s", -1, None) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text[, source]) rows as documents."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
