"""Documents as chunks, questions and drafts of a golden set, benchmark texts as its quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import golden
from siftmill.plans.text_queries import COVERED
from siftmill.sources.tables import read_table, spread


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").withColumnRenamed("text", "quote")


def eligible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return golden.eligible(chunks, _quotes(spark, sf_dir), "doc_id").select("doc_id")


ELIGIBLE_SQL = f"WITH {COVERED} SELECT doc_id FROM documents WHERE length(text) >= 300 AND doc_id NOT IN (SELECT doc_id FROM cov)"


def quote_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts that no document, or more than two, hold."""
    return golden.corpus_findings(_quotes(spark, sf_dir), spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


QUOTES_SQL = f"""WITH {COVERED}, n AS (SELECT b.item_id, count(c.doc_id) AS n FROM benchmark b LEFT JOIN cov c USING (item_id) GROUP BY b.item_id)
SELECT item_id, n, CASE WHEN n = 0 THEN 'in no chunk' ELSE 'in more than two chunks' END AS message FROM n WHERE n = 0 OR n > 2"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (d % n + 1).cast("int"))
    return read_table(spark, sf_dir, "documents").select(
        d.alias("line"), F.when(d % 9 > 0, F.concat(F.lit("q"), F.floor(d / 2).cast("string"))).alias("id"), F.when(d % 8 > 0, F.lit("what?")).otherwise(" ").alias("question"),
        pick(5, "lookup", "multi_hop", "no_answer", "ambiguous", "other").alias("category"), pick(3, "dev", "test", "train").alias("split"), (d % 2).alias("n_quotes"),
    )


def golden_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.findings(_questions(spark, sf_dir))


FINDINGS_SQL = """WITH q AS (SELECT doc_id AS line, CASE WHEN doc_id % 9 > 0 THEN 'q' || doc_id // 2 END AS id, doc_id % 5 AS c FROM documents),
f AS (SELECT id, min(line) AS first FROM q WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
SELECT line, id, 'no id' AS message FROM q WHERE id IS NULL UNION ALL SELECT line, id, 'no question' FROM q WHERE line % 8 = 0 UNION ALL SELECT line, id, 'unknown category' FROM q WHERE c = 4
UNION ALL SELECT line, id, 'unknown split' FROM q WHERE line % 3 = 2 UNION ALL SELECT line, id, 'evidence for a question without an answer' FROM q WHERE c = 2 AND line % 2 = 1
UNION ALL SELECT line, id, 'no evidence' FROM q WHERE c <> 2 AND line % 2 = 0 UNION ALL SELECT line, id, 'id of line ' || first FROM q JOIN f USING (id) WHERE line > first"""


def golden_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.coverage(_questions(spark, sf_dir), ["category", "split"], {"lookup": 40, "ambiguous": 6})


COVERAGE_SQL = """WITH q AS (SELECT ['lookup', 'multi_hop', 'no_answer', 'ambiguous', 'other'][doc_id % 5 + 1] AS category, ['dev', 'test', 'train'][doc_id % 3 + 1] AS split FROM documents)
SELECT category, split, count(*) AS n, CASE WHEN grouping(category) = 0 AND grouping(split) = 1 THEN CASE category WHEN 'lookup' THEN 40 WHEN 'ambiguous' THEN 6 END END AS target FROM q GROUP BY GROUPING SETS ((), (category), (category, split))"""


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return golden.stratified_sample(rows, ["lang"], "doc_id", "s", 30)


SAMPLE_SQL = """WITH e AS (SELECT lang, 30 * count(*)::DOUBLE / (SELECT count(*) FROM documents) AS x FROM documents GROUP BY lang),
s AS (SELECT lang, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, lang) <= 30 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS share FROM e),
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256('s:' || doc_id)) AS place FROM documents)
SELECT doc_id, lang, source FROM r JOIN s USING (lang) WHERE place <= share"""


def promoted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents has a split; two thirds of the others are verified and get one."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test")).alias("split"), (F.col("doc_id") % 9 < 6).alias("verified"))
    return golden.promoted(rows.where("split IS NOT NULL").drop("verified"), rows, "doc_id", ["lang"], "s")


PROMOTED_SQL = """WITH h AS (SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS dev FROM documents WHERE doc_id % 3 = 0 GROUP BY lang),
f AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s:' || doc_id)) AS place, count(*) OVER (PARTITION BY lang) AS new FROM documents WHERE doc_id % 3 > 0 AND doc_id % 9 < 6)
SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, f.lang, CASE WHEN place <= floor((new + coalesce(n, 0)) * 0.4::DOUBLE + 0.5::DOUBLE) - coalesce(dev, 0) THEN 'dev' ELSE 'test' END FROM f LEFT JOIN h USING (lang)"""

QUERIES = {f.__name__: f for f in (eligible_chunks, quote_findings, golden_findings, golden_coverage, stratified_sample, promoted_questions)}
ORACLES = {
    "eligible_chunks": ELIGIBLE_SQL, "quote_findings": QUOTES_SQL, "golden_findings": FINDINGS_SQL, "golden_coverage": COVERAGE_SQL, "stratified_sample": SAMPLE_SQL,
    "promoted_questions": PROMOTED_SQL,
}
