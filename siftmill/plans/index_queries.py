"""Queries of kept indexes over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.inverted import InvertedIndex
from siftmill.operators.neighbours import NeighbourIndex
from siftmill.plans.ranking_queries import COS
from siftmill.plans.text_queries import TOKENS
from siftmill.sources.tables import new_path, read_table, spread

#: Lists that a search reads.
PROBES = 16
QUERY = "The thing that-is and the ing ver keit ciones"


def _changed_index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """The documents; then the benchmark's items under their numbers, which documents have too; then the toxic ones deleted."""
    index = InvertedIndex(spark, new_path(spark, "inverted"))
    index.upsert(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    index.upsert(read_table(spark, sf_dir, "benchmark"), "item_id")
    index.delete(read_table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return index


def kept_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 of the index after two upserts and a delete."""
    return _changed_index(spark, sf_dir).search(QUERY, 20).select("id", F.round("score", 8).alias("score"))


def kept_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document frequencies that the index keeps, after a merge."""
    index = _changed_index(spark, sf_dir)
    index.merge()
    return index.term_frequencies()


CORPUS = f"""c AS MATERIALIZED (SELECT id, {TOKENS} AS tokens FROM (SELECT item_id AS id, coalesce(text, '') AS text FROM benchmark
  UNION ALL SELECT doc_id, coalesce(text, '') FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)) WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
d AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM c) GROUP BY term)"""

SEARCH_SQL = f"""WITH {CORPUS}, q AS (SELECT unnest(tokens) AS term FROM (SELECT {TOKENS} AS tokens FROM (SELECT '{QUERY}' AS text))),
f AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM c), r AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, f), m AS MATERIALIZED (SELECT avg(raw) AS mean FROM r),
w AS MATERIALIZED (SELECT term, count(*) * any_value(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END) AS idf FROM q JOIN r USING (term), m GROUP BY term),
t AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM c), k AS (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM t SEMI JOIN w USING (term) GROUP BY id, term),
s AS (SELECT id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM k JOIN w USING (term), f GROUP BY id)
SELECT id, round(coalesce(score, 0), 8) AS score FROM c LEFT JOIN s USING (id) ORDER BY coalesce(score, 0) DESC, id LIMIT 20"""

TERMS_SQL = f"WITH {CORPUS} SELECT term, df FROM d"



def _neighbours(spark: SparkSession, sf_dir: str, probes: int | None) -> DataFrame:
    """The 10 nearest of every vector whose number is divisible by 100, in an index to which an eighth was added later."""
    rows = read_table(spark, sf_dir, "embeddings")
    index = NeighbourIndex(spark, new_path(spark, "neighbours")).build(rows.where("label <> 0"), "vec_id")
    index.add(rows.where("label = 0 OR label IS NULL"), "vec_id")
    found = index.nearest(rows.where("vec_id % 100 = 0"), 10, probes, "vec_id", others=True)
    return found.select("query", F.col("id").alias("vec_id"), F.round("score", 8).alias("score"))


def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, None)


def nearest_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the probes of which recall is measured (README); SQL has no such search."""
    return _neighbours(spark, sf_dir, PROBES)


NEAREST_SQL = f"""SELECT query, vec_id, round(score, 8) AS score FROM (SELECT b.vec_id AS query, a.vec_id, {COS} AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 10"""

QUERIES = {f.__name__: f for f in (kept_index_search, kept_index_terms, nearest_exact, nearest_probed)}
ORACLES = {"kept_index_search": SEARCH_SQL, "kept_index_terms": TERMS_SQL, "nearest_exact": NEAREST_SQL}
