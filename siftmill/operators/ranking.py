"""Vector search, rank fusion, gates, splits and quotas."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.operators.prefix import running_totals

# Defaults of fusion and gating.
RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 0.7, 0.3
REFUSE_BELOW = {"dense": 0.617442, "hybrid": 0.963599}
COMPOSITE_WEIGHTS = (0.5, 0.3, 0.2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def dense_top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): the k nearest by (cosine desc, id). The query is a literal: a scan and a top-k, no join."""
    asked = F.lit([float(x) for x in query])
    return vectors.select(id_col, cosine(F.col(vector_col), asked).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def ranked(hits: DataFrame, id_col: str) -> DataFrame:
    """(id, rank) of a bounded ranking, by (score desc, id)."""
    return hits.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"))


def rrf(legs: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(id, score): weighted reciprocal rank fusion of (id, rank) legs."""
    parts = [leg.select("id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for leg, w in legs]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("id").agg(F.sum("part").alias("score"))


def refused(top_score: Column, mode: str) -> Column:
    """True without a context (NULL score) or below the mode's threshold."""
    return F.coalesce(top_score < REFUSE_BELOW[mode], F.lit(True))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def composite_confidence(retrieval: Column, coverage: Column, completeness: Column) -> Column:
    """Weighted mean of the parts that are not NULL, within 0 and 1; 0 without any."""
    parts = list(zip((retrieval, coverage, completeness), COMPOSITE_WEIGHTS))
    total = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    weight = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in parts), F.lit(0.0))
    return clamp01(F.coalesce(F.try_divide(total, weight), F.lit(0.0)))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k a task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def stratified_split(rows: DataFrame, strata: list[str], id_col: str, seed: str, dev_share: float = 0.4) -> DataFrame:
    """``rows`` with ``split``: in each stratum the first round-half-up(share x n) by seeded hash are dev.

    Places come from running totals over ranges of hashes, so a stratum is never in one task. Rows that
    repeat an identifier within a stratum share its place.
    """
    places = rows.select(*strata, F.col(id_col).alias("_id")).distinct()
    places = places.withColumn("_order", F.sha2(F.concat_ws(":", F.lit(seed), F.col("_id").cast("string")), 256)).withColumn("_n", F.lit(1))
    ranked = running_totals(places, strata, ["_order"], ["_n"])
    dev = F.col("_n_before") < F.floor(F.col("_n_total") * dev_share + 0.5)
    told = ranked.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], "_id", F.when(dev, "dev").otherwise("test").alias("split"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(strata)], F.col(id_col).eqNullSafe(F.col("_id")))
    return rows.join(told, same).select(*rows.columns, "split")


def largest_remainder(counts: DataFrame, name: str, weight: str, quota: int) -> DataFrame:
    """(name, share): ``quota`` in proportion to the weights, remainders to the largest, ties to the last name.

    The windows run over one row a name.
    """
    exact = counts.select(name, (F.lit(quota) * F.col(weight) / F.sum(weight).over(Window.partitionBy())).alias("exact"))
    parts = exact.select(name, F.floor("exact").alias("whole"), (F.col("exact") - F.floor("exact")).alias("rest"))
    left = F.lit(quota) - F.sum("whole").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), F.desc(name)))
    return parts.select(name, (F.col("whole") + F.when(place <= left, 1).otherwise(0)).alias("share"))


def runs_by_similarity(rows: DataFrame, order_col: str, vector_col: str, group: list[str], below: float = 0.5) -> DataFrame:
    """``rows`` with ``run``: a new run starts where the cosine with the row before is below the break point."""
    by = Window.partitionBy(*group).orderBy(order_col)
    breaks = F.coalesce((cosine(F.lag(vector_col).over(by), F.col(vector_col)) < below).cast("long"), F.lit(0))
    return rows.withColumn("_break", F.when(F.lag(order_col).over(by).isNull(), F.lit(0)).otherwise(breaks)).withColumn("run", F.sum("_break").over(by)).drop("_break")
