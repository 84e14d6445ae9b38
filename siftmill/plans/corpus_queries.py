"""The documents table as files of a corpus and as an index of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import indexing
from siftmill.plans.ranking_queries import COS
from siftmill.sources import corpus
from siftmill.sources.tables import read_table


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return corpus.fingerprint(docs.select(F.format_string("docs/%08d.txt", "doc_id").alias("source_file"), F.col("text").alias("content")))


FINGERPRINT_SQL = r"""SELECT count(*) AS files, sha256(string_agg(format('docs/{:08d}.txt', doc_id) || chr(9) || sha256(text) || chr(10), '' ORDER BY doc_id)) AS digest FROM documents WHERE text IS NOT NULL"""


def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of the documents' numbers, by globs, with their kind."""
    path = F.concat(F.lit("docs/"), F.element_at(F.array(F.lit(""), F.lit("a/"), F.lit("a/b/")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("f"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".MD"), F.lit(".html"), F.lit(".bin"), F.lit(".txt")), (F.col("doc_id") % 4 + 1).cast("int")))
    rows = read_table(spark, sf_dir, "documents").select(path.alias("path"))
    chosen = corpus.selected(F.col("path"), ["docs/**/f*.MD", "docs/*/*", "docs/f?.txt"], ["docs/a/f*1.html"])
    return rows.where(chosen).select("path", corpus.kind_of(F.col("path")).alias("kind"))


SELECTED_SQL = r"""WITH p AS (SELECT 'docs/' || ['', 'a/', 'a/b/'][doc_id % 3 + 1] || 'f' || doc_id || ['.MD', '.html', '.bin', '.txt'][doc_id % 4 + 1] AS path, doc_id % 3 AS depth, doc_id % 4 AS k, doc_id FROM documents)
SELECT path, ['markdown', 'html', NULL, 'text'][k + 1] AS kind FROM p WHERE (k = 0 OR depth = 1 OR (depth = 0 AND k = 3 AND doc_id < 10)) AND NOT (depth = 1 AND k = 1 AND doc_id % 10 = 1)"""


def dropped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, dropped = corpus.drop_lines(F.col("text"), ["^[A-D]", "ing\\.$"])
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(text.cast("binary"), 256).alias("sha"), dropped.cast("long").alias("dropped"))


DROPPED_SQL = r"""WITH l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, regexp_matches(line, '^[A-D]|ing\.$') AS hit FROM l)
SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit), '')) AS sha, count(*) FILTER (hit) AS dropped FROM m GROUP BY doc_id"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.format_string("c%06d", "vec_id").alias("chunk_id"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("source_file"), "embedding", "vec_id")


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: a third is stored, the rest and half of the stored ones come; 0.3 counts as alike."""
    rows = _chunks(spark, sf_dir)
    _, told = indexing.index_chunks(rows.where("vec_id % 3 = 0"), rows.where("vec_id % 3 > 0 OR vec_id % 2 = 0"), threshold=0.3)
    return told


INDEX_SQL = f"""WITH RECURSIVE e AS (SELECT *, vec_id % 3 = 0 AS old FROM embeddings), n AS (SELECT vec_id, row_number() OVER (ORDER BY 's' || label, format('c{{:06d}}', vec_id)) AS i FROM e WHERE NOT old),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.old FROM e a JOIN e b ON NOT b.old AND (a.old OR ('s' || a.label, format('c{{:06d}}', a.vec_id)) < ('s' || b.label, format('c{{:06d}}', b.vec_id))) AND {COS} > 0.3),
o AS MATERIALIZED (SELECT i, vec_id, (SELECT list(a) FROM p WHERE b = vec_id AND NOT old) AS earlier, EXISTS (SELECT 1 FROM p WHERE b = vec_id AND old) AS beaten FROM n),
k AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN beaten OR list_has_any(k.kept, coalesce(o.earlier, [])) THEN k.kept ELSE list_append(k.kept, o.vec_id) END FROM k JOIN o ON o.i = k.i + 1),
c AS (SELECT count(DISTINCT label) AS sources, count(*) AS chunks, count(*) FILTER (vec_id % 3 = 0) AS skipped FROM embeddings WHERE vec_id % 3 > 0 OR vec_id % 2 = 0)
SELECT sources, chunks, skipped, chunks - skipped - len(kept) AS duplicates, len(kept) AS added FROM c, (SELECT kept FROM k ORDER BY i DESC LIMIT 1)"""


def chunks_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.chunks_by_source(_chunks(spark, sf_dir))


BY_SOURCE_SQL = "SELECT 's' || label AS source_file, count(*) AS chunks FROM embeddings GROUP BY label"

QUERIES = {f.__name__: f for f in (corpus_fingerprint, selected_files, dropped_lines, index_chunks, chunks_by_source)}
ORACLES = {"corpus_fingerprint": FINGERPRINT_SQL, "selected_files": SELECTED_SQL, "dropped_lines": DROPPED_SQL, "index_chunks": INDEX_SQL, "chunks_by_source": BY_SOURCE_SQL}
