"""Greedy near-duplicate removal and components over the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import memory
from siftmill.plans.ranking_queries import COS
from siftmill.sources.tables import read_table


def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label in order: kept unless its cosine with an earlier kept one exceeds 0.3."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    pairs = memory.similar_pairs(rows, ["label"], "vec_id", "embedding", 0.3, strict=True)
    return memory.greedy_kept(rows.select("vec_id"), pairs, "vec_id")


DEDUP_SQL = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND {COS} > 0.3),
o AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, (SELECT list(a) FROM p WHERE b = vec_id) AS earlier FROM embeddings),
k AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
SELECT o.i, CASE WHEN list_has_any(k.kept, coalesce(o.earlier, [])) THEN k.kept ELSE list_append(k.kept, o.vec_id) END FROM k JOIN o ON o.i = k.i + 1),
f AS (SELECT kept FROM k ORDER BY i DESC LIMIT 1)
SELECT vec_id, list_contains((SELECT kept FROM f), vec_id) AS kept FROM embeddings"""


def memory_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the vectors of a label under cosine 0.4 or more, with their sizes."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    found = memory.components(rows.select("vec_id"), memory.similar_pairs(rows, ["label"], "vec_id", "embedding", 0.4, spanning=True), "vec_id")
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


COMPONENTS_SQL = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND {COS} >= 0.4),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT e.vec_id, least(e.vec_id, min(r.b)) AS component FROM embeddings e LEFT JOIN r ON r.a = e.vec_id GROUP BY e.vec_id)
SELECT component, count(*) AS n FROM c GROUP BY component HAVING count(*) > 1"""

QUERIES = {f.__name__: f for f in (dedup_greedy, memory_components)}
ORACLES = {"dedup_greedy": DEDUP_SQL, "memory_components": COMPONENTS_SQL}
