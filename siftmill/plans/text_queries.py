"""Text, overlap and retrieval-metric queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import bm25, overlap, retrieval_metrics
from siftmill.sources.tables import read_table, spread, written


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"))


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


NORMALIZE_SQL = r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text FROM documents"""


def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.bm25_tokens(F.col("text")), " ").alias("tokens"))


TOKENS = "list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), regexp_extract_all(lower(text), '[a-z0-9]+(?:[._-][a-z0-9]+)+'))"
BM25_TOKENS_SQL = f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents"


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _docs(spark, sf_dir).select("doc_id", T.bm25_tokens(F.col("text")).alias("tokens"))
    return bm25.term_stats(tokens, id_col="doc_id").select("term", "df", F.round("idf", 8).alias("idf"))


BM25_IDF_SQL = f"""WITH t AS (SELECT doc_id, UNNEST(list_distinct({TOKENS})) AS term FROM documents),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
n AS MATERIALIZED (SELECT count(*) AS n FROM documents), r AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, n), m AS MATERIALIZED (SELECT avg(raw) AS mean FROM r)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 8) AS idf FROM r, m"""


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line of credentials in front: RE2 has no look-around, so there is no SQL for it."""
    line = F.concat(F.lit("db_password = hunter"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.redact(line).alias("text"))


def code_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a fence opened after its first line."""
    text = F.regexp_replace("text", r"^([^\n]*\n)", "$1```\n")
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.round(T.code_share(text), 9).alias("code_share"))


CODE_SHARE_SQL = r"""WITH d AS (SELECT doc_id, text, position(chr(10) IN text) AS nl FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(CASE WHEN nl = 0 THEN 0.0 ELSE greatest(length(text) - nl + 4, nl + 4)::DOUBLE / (length(text) + 4) END, 9) AS code_share FROM d"""


def shared_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.shared_runs(read_table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir))


WORDS = r"regexp_extract_all(lower(text), '[\pL\pN_\pM]+')"
SHARED_RUN_SQL = f"""WITH q AS (SELECT item_id, {WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {WORDS} AS w FROM documents),
qr AS (SELECT item_id, i, array_to_string(w[i:i+5], ' ') AS run FROM q, UNNEST(range(1, len(w) - 4)) AS g(i)),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+5], ' ') AS run FROM d, UNNEST(range(1, len(w) - 4)) AS g(i))
SELECT item_id, doc_id, min_by(run, i) AS run FROM qr JOIN dr USING (run) GROUP BY ALL"""


def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose token sets are alike."""
    pairs = overlap.jaccard_pairs(read_table(spark, sf_dir, "benchmark"), 0.15, "item_id", "text")
    return pairs.select("a", "b", F.round("jaccard", 9).alias("jaccard"))


JACCARD_SQL = f"""WITH s AS (SELECT item_id, list_distinct({WORDS}) AS w FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS n, len(b.w) AS m FROM s a JOIN s b ON a.item_id < b.item_id)
SELECT a, b, round(shared::DOUBLE / (n + m - shared), 9) AS jaccard FROM p WHERE shared::DOUBLE / (n + m - shared) > 0.15"""


def covered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that contain a benchmark text."""
    return overlap.contained_quotes(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark").withColumnRenamed("text", "quote"))


NORMAL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
COVERED = f"""cov AS (SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {NORMAL} AS t FROM documents) d
  JOIN (SELECT item_id, {NORMAL} AS q FROM benchmark) b ON q <> '' AND contains(d.t, b.q))"""
COVERED_SQL = f"WITH {COVERED} SELECT * FROM cov"


def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, and those without and with a benchmark text."""
    hit = covered_items(spark, sf_dir).select("doc_id").distinct().withColumn("hit", F.lit(1))
    counts = _docs(spark, sf_dir).join(hit, "doc_id", "left").groupBy("source")
    return counts.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("contaminated"))


CONTAMINATED_SQL = f"""WITH {COVERED} SELECT source, count(*) AS n, count(c.doc_id) AS contaminated
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM cov) c USING (doc_id) GROUP BY source"""


#: Metrics look no further than this rank.
TOP = 10


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question, item, n_chars, doc_id): a source asks for its contained items; its hits are its longest covering documents."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    return covered_items(spark, sf_dir).join(docs, "doc_id").select(F.col("source").alias("question"), F.col("item_id").alias("item"), "n_chars", "doc_id")


def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1, 3, 5, 10, MRR and nDCG at 10 of each source.

    Items are counted over all covering documents, with partial counts; ranks are cut at TOP where they are made, so
    that each task sends a source's first documents only and no task orders all of them.
    """
    covered = written(_covered(spark, sf_dir), "covered")
    wanted = covered.groupBy("question").agg(F.countDistinct("item").cast("long").alias("n_items"))
    rank = F.dense_rank().over(Window.partitionBy("question").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = covered.withColumn("rank", rank).where(F.col("rank") <= TOP).select("question", "rank", "item")
    scores = retrieval_metrics.scores(wanted, ranked, (1, 3, 5, 10), TOP)
    return scores.select("question", "n_items", *[F.round(c, 9).alias(c) for c in scores.columns[2:]])


RETRIEVAL_SQL = f"""WITH {COVERED},
r AS (SELECT source AS question, dense_rank() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, item_id AS item FROM cov JOIN documents USING (doc_id)),
f AS (SELECT question, item, min(rank) AS r FROM r GROUP BY ALL),
w AS (SELECT question, count(*) AS n_items FROM f GROUP BY question),
j AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY r, item) AS j FROM f),
s AS (SELECT question,
  count(*) FILTER (r <= 1) AS f1, count(*) FILTER (r <= 3) AS f3, count(*) FILTER (r <= 5) AS f5, count(*) FILTER (r <= 10) AS f10,
  min(r) AS first, coalesce(sum(1 / log2(greatest(r, j) + 1)) FILTER (greatest(r, j) <= 10), 0) AS dcg FROM j GROUP BY question)
SELECT w.question, n_items, round(f1 / n_items, 9) AS recall_at_1, round(f3 / n_items, 9) AS recall_at_3, round(f5 / n_items, 9) AS recall_at_5,
  round(f10 / n_items, 9) AS recall_at_10, round(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END, 9) AS mrr_at_10,
  round(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n_items, 10) + 1)]), 9) AS ndcg_at_10 FROM w JOIN s USING (question)"""


def snippet_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items still contained when documents are cut to 150, 300 or no characters.

    What a cut text contains the whole one does, so containment is found once and its pairs are looked at again.
    """
    items, docs = read_table(spark, sf_dir, "benchmark").withColumnRenamed("text", "quote"), _docs(spark, sf_dir)
    heads = docs.select("doc_id", *[T.normalize_ws(F.substring("text", 1, cut)).alias(f"_{cut}") for cut in (150, 300)])
    pairs = overlap.contained_quotes(docs, items).join(heads, "doc_id").join(items.select("item_id", T.normalize_ws(F.col("quote")).alias("_quote")), "item_id")
    held = F.array(F.struct(F.lit(0).alias("cut"), F.lit(True).alias("held")), *[F.struct(F.lit(cut).alias("cut"), F.contains(f"_{cut}", "_quote").alias("held")) for cut in (150, 300)])
    found = pairs.select("item_id", F.inline(held)).where("held").groupBy("cut").agg(F.countDistinct("item_id").alias("found"))
    cuts = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in (150, 300, 0)])).alias("cut"))
    return cuts.join(found, "cut", "left").select("cut", F.coalesce("found", F.lit(0)).alias("found"))


SNIPPET_SQL = f"""WITH c AS (SELECT UNNEST([150, 300, 0]) AS cut),
d AS (SELECT cut, {NORMAL} AS t FROM (SELECT cut, CASE WHEN cut = 0 THEN text ELSE substr(text, 1, cut) END AS text FROM documents, c)),
b AS (SELECT item_id, {NORMAL} AS q FROM benchmark)
SELECT c.cut, count(DISTINCT item_id) AS found FROM c LEFT JOIN (SELECT cut, item_id FROM d JOIN b ON contains(t, q)) x USING (cut) GROUP BY c.cut"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, answer): document texts whose second sentence cites by the id."""
    cite = F.concat(F.lit(". See ["), (F.col("doc_id") % 7).cast("string"), F.lit(", 2]. Also [x] and [3]. End."))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("answer_id"), F.concat(F.substring("source", 1, 40), cite).alias("answer"))


def citations_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited numbers in order, and how many resolve among four contexts."""
    cited = answers(spark, sf_dir).select("answer_id", "answer", T.citation_indices(F.col("answer")).alias("n"))
    resolved = F.size(F.filter("n", lambda i: (i >= 1) & (i <= 4)))
    return cited.select(
        "answer_id", F.array_join(F.col("n").cast("array<string>"), ",").alias("cited"), resolved.cast("long").alias("resolved"),
        F.round(T.answer_completeness(F.col("answer")), 9).alias("completeness"),
    )


CITATIONS_SQL = """WITH a AS (SELECT doc_id AS answer_id, doc_id % 7 AS k FROM documents),
n AS (SELECT answer_id, CASE WHEN k = 2 THEN [2, 3] WHEN k = 3 THEN [3, 2] ELSE [k, 2, 3] END AS n FROM a)
SELECT answer_id, array_to_string(n, ',') AS cited, len(list_filter(n, lambda i: i BETWEEN 1 AND 4)) AS resolved, 0.5::DOUBLE AS completeness FROM n"""


def dedup_exact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different texts by digest: the first document and how often it occurs."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return _docs(spark, sf_dir).groupBy(digest.alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


DEDUP_SQL = "SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1"

QUERIES = {
    f.__name__: f for f in (
        normalize_documents, bm25_tokens, bm25_idf, redact_text, code_share, shared_run, near_dup_jaccard, covered_items,
        contaminated_documents, retrieval_scores, snippet_recall, citations_parse, dedup_exact_text,
    )
}
ORACLES = {
    "normalize_documents": NORMALIZE_SQL, "bm25_tokens": BM25_TOKENS_SQL, "bm25_idf": BM25_IDF_SQL, "code_share": CODE_SHARE_SQL,
    "shared_run": SHARED_RUN_SQL, "near_dup_jaccard": JACCARD_SQL, "covered_items": COVERED_SQL, "contaminated_documents": CONTAMINATED_SQL,
    "retrieval_scores": RETRIEVAL_SQL, "snippet_recall": SNIPPET_SQL, "citations_parse": CITATIONS_SQL, "dedup_exact_text": DEDUP_SQL,
}
