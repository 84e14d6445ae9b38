"""Markdown sections, semantic chunks, excerpts and renderings over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import excerpts, markdown, rendering, structure
from siftmill.sources.tables import read_table, spread


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: a title, the text, and a section below it with the language."""
    text = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n## Language\n"), F.coalesce("lang", F.lit("?")))
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", text.alias("text"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _headed(spark, sf_dir).select("doc_id", F.posexplode(markdown.sections(F.col("text"))).alias("ordinal", "section"))
    return rows.select("doc_id", "ordinal", "section.heading", F.array_join("section.path", markdown.PATH_JOINER).alias("path"), F.char_length("section.text").alias("n_chars"))


SECTIONS_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '?') AS lang, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 0 AS ordinal, 'Document ' || doc_id AS heading, 'Document ' || doc_id AS path, CAST(length(body) AS INT) AS n_chars FROM d WHERE body <> ''
UNION ALL SELECT doc_id, CASE WHEN body = '' THEN 0 ELSE 1 END, 'Language', 'Document ' || doc_id || ' > Language', CAST(length(lang) AS INT) FROM d"""


def heading_path_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.section_chunks(_headed(spark, sf_dir), structure.recursive_chunks, "recursive+heading_path", paths=True)


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, with the vector of the ``embeddings`` row that their hash names."""
    vectors = read_table(spark, sf_dir, "embeddings")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence"))
    keyed = docs.withColumn("key", F.pmod(F.crc32(F.col("sentence").cast("binary")), F.lit(200)))
    own = keyed.join(vectors.select(F.col("vec_id").alias("key"), "embedding"), "key", "left")
    return markdown.semantic_chunks(own, "doc_id", "at", "sentence", "embedding", least_cosine=0.0)


def transcript_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    return turns.groupBy("conv_id").agg(rendering.transcript_digest(lines).alias("digest"))


DIGEST_SQL = r"""WITH t AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS line,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back FROM conversations WHERE text IS NOT NULL),
s AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE back <= 3)
SELECT conv_id, string_agg(CASE WHEN length(line) <= (600 - (n - 1)) // n THEN line ELSE left(line, ((600 - (n - 1)) // n - 1)::INT) || '…' END, chr(10) ORDER BY back DESC) AS digest
FROM s GROUP BY conv_id"""


def tool_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: the user's tasks, the event type as tool, a status by the event's number."""
    status = F.element_at(F.array(*map(F.lit, ("success", "failure", "rejected", "rate_limited"))), (F.col("event_id") % 4 + 1).cast("int"))
    calls = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), status.alias("status"))
    return rendering.tool_outcomes(calls, ["user_id"])


OUTCOMES_SQL = """WITH c AS (SELECT user_id, event_id,
  event_type || ' ' || CASE event_id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'refused' ELSE 'refused (limit)' END AS label FROM events),
g AS (SELECT user_id, label, count(*) AS n, min(event_id) AS first FROM c GROUP BY user_id, label)
SELECT user_id, string_agg(CASE WHEN n > 1 THEN label || ' x' || n ELSE label END, '; ' ORDER BY first) AS outcomes FROM g GROUP BY user_id"""


def token_hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.token_hash_vectors(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "position", F.round("value", 9).alias("value"))


VECTORS_SQL = """WITH w AS (SELECT doc_id, UNNEST(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
p AS (SELECT doc_id, CAST('0x' || right(md5(word), 2) AS BIGINT) AS position, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, position, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS value FROM p"""


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    page = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 10).otherwise(-1)
    return docs.select("doc_id", rendering.source_label(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), page).alias("label"))


LABELS_SQL = """SELECT doc_id, coalesce(source, 'unknown') || CASE WHEN doc_id % 2 = 0 AND coalesce(lang, '') <> '' THEN ' § ' || lang ELSE '' END
  || CASE WHEN doc_id % 3 = 0 AND doc_id % 10 > 0 THEN ' (p.' || doc_id % 10 || ')' ELSE '' END AS label FROM documents"""


def fitted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's five longest documents as the hits of a query that names the source."""
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    best = Window.partitionBy("source").orderBy(F.desc(F.char_length("text")), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(best)).where("rank <= 5")
    hits = ranked.select(
        F.concat(F.lit("what does the source say about time "), F.coalesce("source", F.lit("?"))).alias("query"), F.lit("dense").alias("mode"), "rank",
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_file"), F.lit(None).cast("string").alias("section_heading"),
        (1 / F.col("rank")).alias("score"), "text",
    )
    return excerpts.fit_hits(hits)


QUERIES = {
    f.__name__: f for f in (
        markdown_sections, heading_path_chunks, semantic_chunks, transcript_digest, tool_outcomes, token_hash_vectors, source_labels, fitted_hits,
    )
}
ORACLES = {"markdown_sections": SECTIONS_SQL, "transcript_digest": DIGEST_SQL, "tool_outcomes": OUTCOMES_SQL, "token_hash_vectors": VECTORS_SQL, "source_labels": LABELS_SQL}
