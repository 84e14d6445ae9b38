"""Chunking and search queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import bm25
from siftmill.sources.tables import read_table, spread

QUERY_TERMS = ["the", "and", "that", "with", "the"]

CHUNKS_SQL = """
docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
chunks AS (
  SELECT doc_id, i AS ordinal, substr(text, i * 680 + 1, 800) AS chunk
  FROM docs, UNNEST(generate_series(0, CASE WHEN n = 0 THEN -1 ELSE greatest(0, CAST(ceil((n - 800) / 680.0) AS BIGINT)) END)) AS g(i)
)"""


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ordinal, chunk, chunk_id) of 800/120 windows."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    pieces = docs.select("doc_id", F.posexplode(T.fixed_windows(F.col("text"))).alias("ordinal", "chunk"))
    blank = F.lit(None).cast("string")
    return pieces.select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk",
        T.chunk_id(F.col("doc_id").cast("string"), F.lit("fixed"), F.col("ordinal"), blank, blank, F.col("chunk")).alias("chunk_id"),
    )


FIXED_CHUNKS_SQL = f"""WITH {CHUNKS_SQL}
SELECT doc_id, ordinal, chunk,
  substr(sha1(concat(doc_id, '|fixed|', ordinal, '|', '|', '|', chunk)), 1, 16) AS chunk_id FROM chunks"""


def search_bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 chunks for QUERY_TERMS."""
    chunks = fixed_chunks(spark, sf_dir).select("chunk_id", T.bm25_tokens(F.col("chunk")).alias("tokens"))
    top = bm25.bm25_top_k(chunks, QUERY_TERMS, 10, id_col="chunk_id")
    return top.select("chunk_id", F.round("score", 8).alias("score"))


SEARCH_BM25_SQL = f"""WITH {CHUNKS_SQL},
toks AS (
  SELECT substr(sha1(concat(doc_id, '|fixed|', ordinal, '|', '|', '|', chunk)), 1, 16) AS chunk_id,
    list_concat(regexp_extract_all(lower(chunk), '[a-z0-9]+'), regexp_extract_all(lower(chunk), '[a-z0-9]+(?:[._-][a-z0-9]+)+')) AS tokens FROM chunks),
corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM toks),
df AS (SELECT term, count(*) AS df FROM (SELECT UNNEST(list_distinct(tokens)) AS term FROM toks) GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, corpus),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT * FROM (VALUES ('the', 2.0), ('and', 1.0), ('that', 1.0), ('with', 1.0)) v(term, times)),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, UNNEST(tokens) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
s AS (
  SELECT t.chunk_id, coalesce(sum(q.times * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(t.tokens) / c.avgdl))), 0.0) AS score
  FROM toks t CROSS JOIN corpus c LEFT JOIN tf ON tf.chunk_id = t.chunk_id LEFT JOIN q ON q.term = tf.term LEFT JOIN idf ON idf.term = tf.term
  GROUP BY t.chunk_id)
SELECT chunk_id, round(score, 8) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 10"""

QUERIES = {"fixed_chunks": fixed_chunks, "search_bm25_top10": search_bm25_top10}
ORACLES = {"fixed_chunks": FIXED_CHUNKS_SQL, "search_bm25_top10": SEARCH_BM25_SQL}
