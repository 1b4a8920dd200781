"""The operators bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    from farewise.llm.html import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def q_op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for every document whose id is divisible by 20."""
    from farewise.llm.search import every_nth, top_k

    docs = _table(spark, sf_dir, "documents")
    return top_k(docs, every_nth(docs)).withColumn("score", F.round("score", 6))


def q_op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree and base scores of all documents."""
    from farewise.llm.lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def q_op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    from farewise.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def q_op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into pieces and packed into sequences of 1024 tokens."""
    from farewise.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def q_op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    from farewise.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def q_op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in all documents."""
    from farewise.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def q_op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts (white space aside) of all documents."""
    from farewise.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def q_op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by co-trained content and metadata views."""
    from farewise.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def q_op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together."""
    from farewise.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


def q_op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    from farewise.llm.ranked import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def q_op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents and what they decode to, as digests."""
    from farewise.llm.pieces import piece_digests

    return piece_digests(_table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def q_op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100."""
    from farewise.llm.negatives import hard_negatives

    return hard_negatives(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html": q_op1_html,
    "op2_search": q_op2_search,
    "op3_lm": q_op3_lm,
    "op4_simhash": q_op4_simhash,
    "op5_packing": q_op5_packing,
    "op6_mixing": q_op6_mixing,
    "op7_licenses": q_op7_licenses,
    "op8_exact_dedup": q_op8_exact_dedup,
    "op9_quality": q_op9_quality,
    "op10_sharding": q_op10_sharding,
    "op11_ranked": q_op11_ranked,
    "op12_pieces": q_op12_pieces,
    "op13_negatives": q_op13_negatives,
}

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op2_search": f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')) AS w
  FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM words GROUP BY doc_id, w),
len AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
n AS (SELECT count(*) AS n, (SELECT sum(dl) FROM len) / count(*) AS mean FROM documents),
idf AS (SELECT w, ln(1 + (n.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY w, n.n),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(idf.idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len.dl / n.mean))), 8) AS score
  FROM tf q JOIN idf ON idf.w = q.w JOIN tf d ON d.w = q.w JOIN len ON len.doc_id = d.doc_id, n
  WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, d.doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10""",
    "op8_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op11_ranked": f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_TERM}')) AS w
  FROM documents),
tf AS (SELECT doc_id, w, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY doc_id, w),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM len),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // words AS m FROM len, total),
weights AS (SELECT w, CAST(floor(1000 * ln((2.0 * docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY w, docs),
asked AS (
  SELECT item_id, w, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '{_TERM}')) AS w FROM benchmark) q
  GROUP BY item_id, w),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (w) JOIN tf USING (w) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_negatives": """
WITH d AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM d a JOIN d b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, al FROM s WHERE label = al
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.al
   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
