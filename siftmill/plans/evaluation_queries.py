"""Evaluation statistics over labels (as verdicts), documents (as strata) and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import evaluation as E
from siftmill.operators.prefix import nearest_ranks
from siftmill.sources.tables import read_table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents should be refused; those of low quality were. The score is of the identifier."""
    return read_table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("toxic") == 1).alias("expected"), (F.col("quality") == 0).alias("actual"), ((F.col("doc_id") % 17) / 16.0).alias("score")
    )


LABELS = "l AS (SELECT doc_id, toxic = 1 AS expected, quality = 0 AS actual, (doc_id % 17) / 16.0::DOUBLE AS score FROM labels)"


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[c if c in keep else F.round(c, 9).alias(c) for c in df.columns])


def refusal_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_labels(spark, sf_dir).agg(*E.prf(F.col("expected"), F.col("actual"))), "tp", "fp", "fn", "tn")


PRF_SQL = f"""WITH {LABELS}, c AS (SELECT count_if(expected AND actual)::BIGINT AS tp, count_if(NOT expected AND actual)::BIGINT AS fp, count_if(expected AND NOT actual)::BIGINT AS fn, count_if(NOT expected AND NOT actual)::BIGINT AS tn FROM l)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM c"""


def refusal_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = _rounded(E.refusal_sweep(_labels(spark, sf_dir)), "threshold", "tp", "fp", "fn")
    return swept.withColumn("threshold", F.col("threshold").cast("string")).withColumn("threshold", F.when(F.col("threshold") == "Infinity", "inf").otherwise(F.col("threshold")))


SWEEP = f"""{LABELS}, t AS (SELECT DISTINCT score AS threshold FROM l UNION ALL SELECT 'inf'::DOUBLE),
c AS (SELECT threshold, count_if(expected AND score < threshold)::BIGINT AS tp, count_if(NOT expected AND score < threshold)::BIGINT AS fp, count_if(expected AND score >= threshold)::BIGINT AS fn FROM t, l GROUP BY threshold),
s AS (SELECT threshold, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c)"""
SWEEP_SQL = f"WITH {SWEEP} SELECT threshold::VARCHAR AS threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM s"


def choose_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = E.choose_threshold(E.refusal_sweep(_labels(spark, sf_dir)))
    return best.select(F.when(F.col("threshold") < float("inf"), F.col("threshold")).alias("threshold"), F.round("f1", 9).alias("f1"))


CHOOSE_SQL = f"WITH {SWEEP} SELECT CASE WHEN threshold < 'inf'::DOUBLE THEN threshold END AS threshold, round(f1, 9) AS f1 FROM s ORDER BY s.f1 DESC NULLS LAST, s.threshold LIMIT 1"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).join(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


JUDGED = f"{LABELS}, j AS (SELECT l.*, lang, source FROM l JOIN documents USING (doc_id))"


def false_refusals_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused documents that should not be, in all, by language and by source; even identifiers are the gate's."""
    rows = _judged(spark, sf_dir).where(~F.col("expected"))
    gate = F.col("doc_id") % 2 == 0
    return rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("actual") & gate).alias("by_gate"), F.count_if(F.col("actual") & ~gate).alias("by_model")
    )


FALSE_SQL = f"""WITH {JUDGED} SELECT lang, source, count(*) AS n, count_if(actual AND doc_id % 2 = 0)::BIGINT AS by_gate, count_if(actual AND doc_id % 2 = 1)::BIGINT AS by_model
FROM j WHERE NOT expected GROUP BY GROUPING SETS ((), (lang), (source))"""


def wilson_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _judged(spark, sf_dir).groupBy("lang").agg(F.count_if(~F.col("actual")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return counts.select("lang", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


WILSON_SQL = f"""WITH {JUDGED}, c AS (SELECT lang, count_if(NOT actual)::BIGINT AS k, count(*) AS n, 1.96::DOUBLE AS z FROM j GROUP BY lang),
w AS (SELECT *, (k / n + z * z / (2 * n)) / (1 + z * z / n) AS centre, z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half FROM c)
SELECT lang, k, n, round(greatest(0, centre - half), 9) AS low, round(least(1, centre + half), 9) AS high FROM w"""


def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("lang").agg(F.round(E.cohens_kappa(F.col("expected"), F.col("actual")), 9).alias("kappa"))


KAPPA_SQL = f"""WITH {JUDGED}, c AS (SELECT lang, avg((expected = actual)::INT) AS po, avg(expected::INT) AS a, avg(actual::INT) AS b FROM j GROUP BY lang),
p AS (SELECT lang, po, a * b + (1 - a) * (1 - b) AS pe FROM c) SELECT lang, round(CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa FROM p"""


def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _judged(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("expected") & ~F.col("actual")).alias("a"), F.count_if(~F.col("expected") & F.col("actual")).alias("b"))
    return counts.select("source", "a", "b", F.round(E.mcnemar_p(F.col("a"), F.col("b")), 9).alias("p"))


MCNEMAR_SQL = f"""WITH RECURSIVE {JUDGED}, c AS (SELECT source, count_if(expected AND NOT actual)::BIGINT AS a, count_if(NOT expected AND actual)::BIGINT AS b FROM j GROUP BY source),
t AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)) AS term FROM (SELECT *, unnest(range(least(a, b) + 1)) AS i FROM c))
SELECT source, a, b, round(CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * sum(term)) END, 9) AS p FROM t GROUP BY source, a, b"""


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of quality minus refusal by language, of 10,000 seeded resamples: no SQL."""
    differences = _judged(spark, sf_dir).select("lang", (F.col("expected").cast("double") - F.col("actual").cast("double")).alias("difference"))
    return E.paired_bootstrap(differences, ["lang"], "difference")


def latency_percentiles_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of event values."""
    found = nearest_ranks(read_table(spark, sf_dir, "events"), ["event_type"], "value", (50, 95, 99))
    return found.select("event_type", "n", *[F.round(c, 3).alias(c) for c in ("p50", "p95", "p99")])


LATENCY_SQL = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n, round(max(value) FILTER (rn = (n * 50 + 99) // 100), 3) AS p50, round(max(value) FILTER (rn = (n * 95 + 99) // 100), 3) AS p95, round(max(value) FILTER (rn = (n * 99 + 99) // 100), 3) AS p99
FROM r GROUP BY event_type, n"""


def task_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tasks, turns as criteria: the first two are critical, the third has no verdict."""
    turns = read_table(spark, sf_dir, "conversations")
    rubric = turns.select(F.col("conv_id").alias("task"), F.col("turn").alias("criterion"), (F.col("turn") < 2).alias("critical")).distinct()
    verdicts = turns.where("turn <> 2").select(F.col("conv_id").alias("task"), F.col("turn").alias("criterion"), (F.char_length("text") % 5 > 0).alias("passed"))
    return E.task_success(E.criteria_passed(rubric, verdicts)).select("task", "success", F.round("critical_share", 9).alias("critical_share"))


SUCCESS_SQL = """WITH r AS (SELECT DISTINCT conv_id AS task, turn AS criterion, turn < 2 AS critical FROM conversations),
v AS (SELECT conv_id AS task, turn AS criterion, bool_and(length(text) % 5 > 0) AS p FROM conversations WHERE turn <> 2 GROUP BY ALL),
c AS (SELECT r.*, coalesce(p, false) AS passed FROM r LEFT JOIN v USING (task, criterion))
SELECT task, bool_and(passed) FILTER (critical) AS success, round(count_if(critical AND passed) / nullif(count_if(critical), 0), 9) AS critical_share FROM c GROUP BY task"""

QUERIES = {
    f.__name__: f for f in (
        refusal_prf, refusal_sweep, choose_threshold, false_refusals_by_stratum, wilson_by_lang, cohens_kappa, mcnemar_exact,
        paired_bootstrap, latency_percentiles_by_type, task_success,
    )
}
ORACLES = {
    "refusal_prf": PRF_SQL, "refusal_sweep": SWEEP_SQL, "choose_threshold": CHOOSE_SQL, "false_refusals_by_stratum": FALSE_SQL,
    "wilson_by_lang": WILSON_SQL, "cohens_kappa": KAPPA_SQL, "mcnemar_exact": MCNEMAR_SQL, "latency_percentiles_by_type": LATENCY_SQL, "task_success": SUCCESS_SQL,
}
