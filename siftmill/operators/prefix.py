"""Running totals over rows in order, without a task that gets all rows of a group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.sources.tables import written


def joined_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on keys of equal name, NULL equal to NULL; ``left``'s keys stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], F.lit(True))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def running_totals(rows: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with, for each value column v, ``v_before`` (sum over the group's earlier rows) and ``v_total``.

    Rows are dealt by ranges of (group, order) and written; a range's sums are one row a group and range, so
    the only windows over a whole group run over its ranges. Within a range rows are numbered on their own.
    Orders must be unique within a group for a defined result; NULL groups are one group; NULL values count
    as 0. An empty table gives an empty result.
    """
    dealt = written(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*group, "_range").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    starts = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_at"),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}_start") for v in values], *[F.sum(v).over(whole).alias(f"{v}_total") for v in values],
    )
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_range") == F.col("_at"))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_{v}_in") for v in values])
    located = counted.join(starts, same)
    return located.select(
        *rows.columns, *[(F.col(f"_{v}_start") + F.col(f"_{v}_in")).alias(f"{v}_before") for v in values], *[f"{v}_total" for v in values]
    )


def nearest_ranks(rows: DataFrame, group: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """(group..., n, p50, ...): nearest-rank percentiles of the value by group; NULL values are left out.

    The rank of p is ceil(p n / 100), in whole numbers. Values are counted first, then ranked by running
    totals, so neither a group nor its different values meet in one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, group, ["_value"], ["_n"])

    def at(p: int):
        rank = F.greatest(F.lit(1), F.floor((F.col("_n_total") * p + 99) / 100))
        return F.max(F.when((F.col("_n_before") < rank) & (rank <= F.col("_n_before") + F.col("_n")), F.col("_value"))).alias(f"p{p}")

    return ranked.groupBy(*group).agg(F.first("_n_total").alias("n"), *[at(p) for p in percents])


def medians(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group..., n, median): the middle value of each group, the mean of the two in the middle of an even number.

    As :func:`nearest_ranks`, by running totals over counted values; NULL values are left out, NULL is a group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, group, ["_value"], ["_n"])

    def at(rank):
        return F.max(F.when((F.col("_n_before") < rank) & (rank <= F.col("_n_before") + F.col("_n")), F.col("_value")))

    n = F.col("_n_total")
    return ranked.groupBy(*group).agg(F.first("_n_total").alias("n"), ((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2).alias("median"))
