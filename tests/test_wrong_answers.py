"""Cases that once came out wrong: large paired counts, rows without a stratum or group, prompts of all keys."""

import math
from fractions import Fraction

from pyspark.sql import functions as F

from siftmill.operators import evaluation, golden, logs, reports


def exact(a, b):
    d, m = a + b, min(a, b)
    return float(min(Fraction(1), Fraction(2 * sum(math.comb(d, i) for i in range(m + 1)), 2**d))) if d else 1.0


def test_mcnemar_of_many_pairs(spark):
    cases = [(0, 0), (0, 5), (3, 3), (1, 9), (15, 16), (16, 40), (500, 600), (1100, 1100), (2986, 3049), (2000, 2500), (0, 3000), (10, 2000)]
    df = spark.createDataFrame(cases, "a long, b long").withColumn("p", evaluation.mcnemar_p(F.col("a"), F.col("b")))
    for r in df.collect():
        assert math.isclose(r.p, exact(r.a, r.b), rel_tol=1e-11, abs_tol=1e-300), (r, exact(r.a, r.b))
    huge = spark.range(1).select(evaluation.mcnemar_p(F.lit(5_000_000_000), F.lit(5_000_100_000)).alias("p")).first().p
    assert math.isclose(huge, math.erfc(99_999 / math.sqrt(10_000_100_000) / math.sqrt(2)), rel_tol=1e-4)


def test_rows_without_a_stratum_stay(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "en") for i in range(100)], "id int, lang string")
    drawn = golden.stratified_sample(rows, ["lang"], "id", "s", 20).collect()
    assert len(drawn) == 20 and sum(r.lang is None for r in drawn) == 10
    fresh = rows.withColumn("verified", F.lit(True)).withColumn("split", F.lit(None).cast("string"))
    grown = golden.promoted(fresh.limit(0).drop("verified"), fresh, "id", ["lang"], "s")
    assert {(r.lang, r.split): r.n for r in grown.groupBy("lang", "split").agg(F.count("*").alias("n")).collect()} == {(None, "dev"): 20, (None, "test"): 30, ("en", "dev"): 20, ("en", "test"): 30}


def test_groups_without_a_name_have_percentiles(spark):
    records = spark.createDataFrame([(i, None, "dev", None if i % 2 else "a", float(i)) for i in range(10)], "id int, lang string, split string, arm string, ms double")
    told = reports.ablation_arms(records, ["id"], ["ms"]).collect()
    assert {r.arm: (r.ms_p50, r.ms_p95) for r in told} == {None: (5.0, 9.0), "a": (4.0, 8.0)}


def test_a_ceiling_of_cost_is_reached_exactly(spark):
    calls = spark.createDataFrame([(i, "a", 0.1) for i in range(12)] + [(i, "b", c) for i, c in enumerate((None, 1e300, 1.0))], "id int, task string, cost double")
    over = logs.over_ceiling(calls, "task", "cost", ["id"], 0x7FFFFFFF, 1.0).collect()
    assert sorted((r.task, r.id, round(r.cost_before, 9)) for r in over) == [("a", 10, 1.0), ("a", 11, 1.1), ("b", 2, 1e300)]
