"""Reports of small result tables: ablations, cells, Markdown tables and rounded records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators.evaluation import RESAMPLES, SEED, paired_bootstrap
from siftmill.operators.prefix import joined_on, nearest_ranks

# What stands for no value, and the digits of a record's numbers.
NONE, RECORD_DIGITS = "n/a", 6


def ablation_arms(records: DataFrame, metrics: list[str], times: list[str]) -> DataFrame:
    """(split, arm, n, mean of each metric, p50 and p95 of each time) of ``records`` (id, split, arm, ...).

    NULL metrics and times are left out of their means and percentiles; an arm without times has NULL.
    """
    out = records.groupBy("split", "arm").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    for time in times:
        ranks = nearest_ranks(records.where(F.col(time).isNotNull()), ["split", "arm"], time, (50, 95))
        out = joined_on(out, ranks.select("split", "arm", F.col("p50").alias(f"{time}_p50"), F.col("p95").alias(f"{time}_p95")), ["split", "arm"], "left")
    return out


def ablation_differences(records: DataFrame, reference: str, metrics: list[str], stratum: str) -> DataFrame:
    """(split, arm, stratum, metric, difference): each arm's question less the reference's, for its stratum and for ``all``."""
    measured = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")
    own = records.select("id", "split", "arm", F.col(stratum).cast("string").alias("_stratum"), measured).select("id", "split", "arm", "_stratum", "_m.*").where("value IS NOT NULL")
    base = own.where(F.col("arm") == reference).select("id", "split", "metric", F.col("value").alias("_base"))
    pairs = own.where(F.col("arm") != reference).join(base, ["id", "split", "metric"])
    strata = F.explode(F.array_compact(F.array(F.lit("all"), F.col("_stratum")))).alias("stratum")
    return pairs.select("split", "arm", strata, "metric", (F.col("value") - F.col("_base")).alias("difference"))


def ablation_intervals(records: DataFrame, reference: str, metrics: list[str], stratum: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(split, arm, stratum, metric, n, mean, low, high): the paired bootstrap of :func:`ablation_differences`."""
    differences = ablation_differences(records, reference, metrics, stratum)
    return paired_bootstrap(differences, ["split", "arm", "stratum", "metric"], "difference", resamples, seed)


def number_cell(value: Column) -> Column:
    """Three decimals, halves up."""
    return F.coalesce(F.when(value.isNotNull(), F.format_string("%.3f", value)), F.lit(NONE))


def interval_cell(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNull(), NONE).otherwise(F.format_string("%.3f [%.2f, %.2f]", value, low, high))


def markdown_table(rows: DataFrame, cells: dict[str, Column], order: list[str]) -> DataFrame:
    """One row (text): a Markdown table with a column for each of ``cells``, its rows by ``order``.

    For result tables of a few rows, as of arms or strata: the text is one value. NULL cells are ``n/a``; an
    empty table has its head alone.
    """
    bar = lambda parts: f"| {' | '.join(parts)} |"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit(NONE)) for c in cells.values()]), F.lit(" |"))
    body = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda r: r["_line"])
    head = F.array(F.lit(bar(cells)), F.lit("|" + "|".join("---" for _ in cells) + "|"))
    return rows.agg(F.array_join(F.concat(head, body), "\n").alias("text"))


def rounded(rows: DataFrame, digits: int = RECORD_DIGITS) -> DataFrame:
    """Doubles to six decimals, but for columns named for a threshold, at which a rounded value could turn a verdict."""
    doubles = [name for name, kind in rows.dtypes if kind in ("double", "float") and "threshold" not in name]
    return rows.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in rows.columns])


def section(title: str, table: DataFrame) -> DataFrame:
    """One row (text): a table's text under a heading."""
    return table.select(F.concat(F.lit(f"## {title}\n\n"), "text").alias("text"))


def write_report(sections: list[DataFrame], path: str) -> None:
    """The sections in their order, as one text file in the folder ``path`` of any file system."""
    numbered = [s.select(F.lit(i).alias("_i"), "text") for i, s in enumerate(sections)]
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_i", "text"))), lambda s: s["text"])
    reduce(DataFrame.union, numbered).agg(F.array_join(texts, "\n\n").alias("text")).write.mode("overwrite").text(path)


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines of the :func:`rounded` rows, in parallel."""
    rounded(rows).write.mode("overwrite").json(path)
