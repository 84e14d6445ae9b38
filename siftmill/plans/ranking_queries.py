"""Vector search, fusion, gating, memory and split queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import bm25, ranking
from siftmill.sources.tables import read_table, spread

TERMS = ["the", "and", "that", "with"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = _vectors(spark, sf_dir).where("vec_id = 0").select("embedding").first()  # one row, its filter pushed down
    return list(row["embedding"]) if row else []


def search_dense_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to vector 0."""
    top = ranking.dense_top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10)
    return top.select("vec_id", F.round("score", 8).alias("score"))


DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
COS = f"({DOT} / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"
DENSE = f"SELECT a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, a.vec_id"
DENSE_SQL = f"SELECT vec_id, round(score, 8) AS score FROM ({DENSE} LIMIT 10)"


def search_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 dense and 20 BM25 candidates fused 0.7 to 0.3; vectors and documents share their identifiers."""
    dense = ranking.dense_top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20)
    tokens = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    sparse = bm25.bm25_top_k(tokens, TERMS, 20, id_col="doc_id")
    fused = ranking.rrf([(ranking.ranked(dense, "vec_id"), ranking.DENSE_WEIGHT), (ranking.ranked(sparse, "doc_id"), ranking.SPARSE_WEIGHT)])
    return fused.select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)


HYBRID_SQL = f"""WITH toks AS (SELECT doc_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[._-][a-z0-9]+)+')) AS tokens FROM documents),
c AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM toks),
df AS (SELECT term, count(*) AS df FROM (SELECT UNNEST(list_distinct(tokens)) AS term FROM toks) GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, c),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw WHERE term IN ('the', 'and', 'that', 'with')),
sc AS (SELECT doc_id, coalesce((SELECT sum(idf * k * 2.5 / (k + 1.5 * (0.25 + 0.75 * len(t.tokens) / avgdl))) FROM (SELECT idf, len(list_filter(t.tokens, lambda x: x = term)) AS k FROM idf) z), 0.0) AS score FROM toks t, c),
s AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc ORDER BY score DESC, doc_id LIMIT 20),
d AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({DENSE} LIMIT 20)),
u AS (SELECT id, 0.7::DOUBLE / (60 + rank) AS p FROM d UNION ALL SELECT id, 0.3::DOUBLE / (60 + rank) FROM s)
SELECT id, round(sum(p), 9) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 20"""


def refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label as a question: its top cosine with vector 0, and whether either mode refuses."""
    asked = F.lit(_query_vector(spark, sf_dir))
    top = _vectors(spark, sf_dir).where("vec_id <> 0").groupBy("label").agg(F.max(ranking.cosine(F.col("embedding"), asked)).alias("top"))
    return top.select("label", F.round("top", 8).alias("top"), ranking.refused(F.col("top"), "dense").alias("dense"), ranking.refused(F.col("top"), "hybrid").alias("hybrid"))


GATE_SQL = f"""WITH t AS (SELECT a.label, max({COS}) AS top FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0 GROUP BY a.label)
SELECT label, round(top, 8) AS top, top < 0.617442 AS dense, top < 0.963599 AS hybrid FROM t"""


def composite_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts: quality as coverage (NULL if toxic), parity as completeness."""
    rows = read_table(spark, sf_dir, "labels")
    score = ranking.composite_confidence(
        F.col("doc_id") % 10 / 10.0, F.when(F.col("toxic") == 0, F.col("quality").cast("double")), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 2).cast("double"))
    )
    return rows.select("doc_id", F.round(score, 9).alias("confidence"))


COMPOSITE_SQL = """WITH p AS (SELECT doc_id, (doc_id % 10) / 10.0::DOUBLE AS r, CASE WHEN toxic = 0 THEN quality::DOUBLE END AS c, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 2)::DOUBLE END AS m FROM labels)
SELECT doc_id, round((0.5 * r + coalesce(0.3 * c, 0) + coalesce(0.2 * m, 0)) / (0.5 + CASE WHEN c IS NULL THEN 0 ELSE 0.3 END + CASE WHEN m IS NULL THEN 0 ELSE 0.2 END)::DOUBLE, 9) AS confidence FROM p"""


def memory_topk_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three memories of each kind nearest to vector 0."""
    asked = F.lit(_query_vector(spark, sf_dir))
    scored = _vectors(spark, sf_dir).select("label", "vec_id", (1 - ranking.cosine(F.col("embedding"), asked)).alias("distance"))
    return ranking.top_per_group(scored, ["label"], [F.asc("distance"), F.asc("vec_id")], 3).select("label", "vec_id", "rank", F.round("distance", 8).alias("distance"))


TOPK_SQL = f"""WITH d AS (SELECT a.label, a.vec_id, 1 - {COS} AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0)
SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank, round(distance, 8) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY d.distance, vec_id) <= 3"""


def semantic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label in order as sentences, cut where neighbours are unlike."""
    runs = ranking.runs_by_similarity(_vectors(spark, sf_dir), "vec_id", "embedding", ["label"], 0.1)
    return runs.groupBy("label", "run").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


RUNS_SQL = """WITH l AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
b AS (SELECT label, vec_id, CASE WHEN p IS NOT NULL AND list_dot_product(p, e) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(e, e))) < 0.1 THEN 1 ELSE 0 END AS b FROM l),
r AS (SELECT label, vec_id, CAST(sum(b) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS run FROM b)
SELECT label, run, min(vec_id) AS first_id, count(*) AS n FROM r GROUP BY label, run"""


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return ranking.stratified_split(rows, ["lang", "source"], "doc_id", "seed-1").select("doc_id", "split")


SPLIT_SQL = """WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('seed-1:' || doc_id)) AS place, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
SELECT doc_id, CASE WHEN place <= floor(n * 0.4::DOUBLE + 0.5::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM p"""


def largest_remainder_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return ranking.largest_remainder(counts, "lang", "n", 25)


QUOTA_SQL = """WITH e AS (SELECT lang, 25 * count(*)::DOUBLE / (SELECT count(*) FROM documents) AS exact FROM documents GROUP BY lang),
p AS (SELECT lang, CAST(floor(exact) AS BIGINT) AS whole, exact - floor(exact) AS rest FROM e)
SELECT lang, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang DESC) <= 25 - sum(whole) OVER () THEN 1 ELSE 0 END AS share FROM p"""

QUERIES = {
    f.__name__: f for f in (
        search_dense_top10, search_hybrid_rrf, refusal_gate, composite_confidence, memory_topk_per_kind, semantic_runs, stratified_split, largest_remainder_quota,
    )
}
ORACLES = {
    "search_dense_top10": DENSE_SQL, "search_hybrid_rrf": HYBRID_SQL, "refusal_gate": GATE_SQL, "composite_confidence": COMPOSITE_SQL,
    "memory_topk_per_kind": TOPK_SQL, "semantic_runs": RUNS_SQL, "stratified_split": SPLIT_SQL, "largest_remainder_quota": QUOTA_SQL,
}
