"""Recall, MRR and nDCG over (question, rank, item) rows: the items that the hit at a rank covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_ranks(ranked: DataFrame) -> DataFrame:
    """(question, item, rank): the first rank at which a question's item is covered."""
    return ranked.groupBy("question", "item").agg(F.min("rank").alias("rank"))


def _discount(place: Column) -> Column:
    return F.lit(1.0) / F.log2(place + 1)


def scores(wanted: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), top: int = 10) -> DataFrame:
    """(question, n_items, recall_at_k..., mrr_at_top, ndcg_at_top) of each row of ``wanted`` (question, n_items).

    The j-th item found is credited at its rank, or at j if several items share a rank before it. A
    question without hits scores 0; one without items has NULL scores.
    """
    place = F.row_number().over(Window.partitionBy("question").orderBy("rank", "item"))
    found = first_ranks(ranked).withColumn("place", F.greatest(F.col("rank"), place))
    totals = found.groupBy("question").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in ks],
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("place") <= top, _discount(F.col("place")))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_items", F.lit(top)).cast("int")), F.lit(0.0), lambda acc, i: acc + _discount(i))
    has = F.col("n_items") > 0
    return wanted.join(totals, "question", "left").select(
        "question", "n_items",
        *[F.try_divide(F.coalesce(f"found_{k}", F.lit(0)).cast("double"), "n_items").alias(f"recall_at_{k}") for k in ks],
        F.when(has, F.when(F.col("first") <= top, F.lit(1.0) / F.col("first")).otherwise(0.0)).alias(f"mrr_at_{top}"),
        F.when(has, F.coalesce("dcg", F.lit(0.0)) / F.when(has, ideal)).alias(f"ndcg_at_{top}"),
    )
