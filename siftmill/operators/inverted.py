"""A kept inverted index: postings as tables in a folder, changed by upserts, read by BM25 queries.

An upsert or a delete writes a segment: its postings (by term bucket, sorted by term), its rows with the terms
they have and their counts, the earlier rows it puts out of force (tombstones), what it adds to each term's document frequency,
and last a commit row with what it adds to the corpus figures. Folders without a commit don't count, so a
failed write changes nothing. A posting has the length of its row, so a query reads the postings of its own
terms, the tombstones and the commits: no text, no tokens, no other term. A merge writes all that is in force
as one segment; queries see the segments from the last merge on.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftmill.functions import text as T
from siftmill.operators.bm25 import B, EPSILON, K1
from siftmill.sources.tables import CLEAN_UP, remove, written_at

#: Folders that postings are dealt to by the hash of the term.
BUCKETS = 64

#: Rows of a segment to a task of one bucket's postings.
SALT_ROWS = 200_000

TERMS = "terms array<struct<term: string, tf: int>>"
COMMIT = "segment int, base int, n long, tokens long"


def _counted(rows: DataFrame) -> DataFrame:
    """(id, length, terms) of (id, text): each row's tokens as :func:`siftmill.functions.text.bm25_tokens` gives them, counted
    in the row by Spark's own expressions, so no text goes to a Python worker. Tokens are sorted; where one differs from the
    token before it, a term begins, which ends where the next one begins."""
    tokens = rows.select("id", F.sort_array(T.bm25_tokens(F.col("text"))).alias("tokens"))
    begins = F.transform("tokens", lambda token, i: F.when((i == 0) | (token != F.get("tokens", i - 1)), i))
    begun = tokens.select("id", "tokens", F.size("tokens").alias("length"), F.array_compact(begins).alias("begins"))
    tf = lambda i, k: F.coalesce(F.get("begins", k + 1), F.col("length")) - i
    return begun.select("id", "length", F.transform("begins", lambda i, k: F.struct(F.get("tokens", i).alias("term"), tf(i, k).alias("tf"))).alias("terms"))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class InvertedIndex:
    """An index at ``path``, of any file system that Spark writes. One writer at a time; readers see commits.

    Identifiers are of one type, given when the first rows come; NULL identifiers are not indexed; NULL texts
    have no tokens, but count as rows. Of rows of one identifier in an upsert the last by ``order_col`` counts,
    without one the greatest text.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def commits(self) -> list:
        """The commits in force, from the last merge on: a few rows."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").orderBy("segment").collect()
        except AnalysisException:  # no folder yet
            return []
        base = max((r["base"] for r in rows), default=0)
        return [r for r in rows if r["segment"] >= base]

    def _read(self, table: str, schema: str) -> DataFrame:
        """The rows of a table's segments in force; only their folders are listed."""
        at = [f"{self.path}/{table}/segment={r['segment']}" for r in self.commits()]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{table}").schema(schema).parquet(*at)

    def _id(self) -> str:
        return dict(self.spark.read.parquet(f"{self.path}/rows/segment={self.commits()[-1]['segment']}").dtypes)["id"]

    def postings(self) -> DataFrame:
        """(term, id, tf, length, segment, bucket) of all segments, rows out of force included."""
        return self._read("postings", f"term string, id {self._id()}, tf int, length int, segment int, bucket int")

    def dead(self) -> DataFrame:
        return self._read("dead", f"id {self._id()}, of int, segment int").select("id", F.col("of").alias("segment"))

    def rows(self) -> DataFrame:
        """(id, length, terms, segment) of the rows in force."""
        return self._read("rows", f"id {self._id()}, length int, {TERMS}, segment int").join(self.dead(), ["id", "segment"], "left_anti")

    def term_frequencies(self) -> DataFrame:
        """(term, df) of the rows in force, added up from the segments' differences."""
        added = self._read("terms", "term string, added long, segment int")
        return added.groupBy("term").agg(F.sum("added").alias("df")).where("df > 0")

    def totals(self) -> tuple[int, int]:
        """(rows, tokens) in force."""
        return sum(r["n"] for r in self.commits()), sum(r["tokens"] for r in self.commits())

    def _write(self, df: DataFrame, table: str, number: int) -> DataFrame:
        """Writes a table of a segment, whose shuffle files go with the write, and reads it back."""
        before = self.spark.conf.get(CLEAN_UP)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/{table}/segment={number}")
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}/segment={number}")

    def _write_postings(self, postings: DataFrame, n: int, number: int) -> None:
        """Postings dealt by bucket and, so that a frequent term is many tasks' work, by the hash of the row."""
        salts = F.pmod(F.xxhash64("id"), F.lit(math.ceil(n / SALT_ROWS) or 1))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = postings.select("term", "id", "tf", "length", "bucket").repartition(tasks, "bucket", salts).sortWithinPartitions("bucket", "term", "id")
        before = self.spark.conf.get(CLEAN_UP)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        finally:
            self.spark.conf.set(CLEAN_UP, before)

    def _segment(self, fresh: DataFrame, gone) -> None:
        """Writes ``fresh`` (id, length, terms) and the tombstones of the rows in force that ``gone`` picks by the new ids."""
        known = self.commits()
        number = max((r["segment"] for r in known), default=-1) + 1
        new = self._write(fresh, "rows", number)
        kind = dict(fresh.dtypes)["id"]
        lost = gone(new.select("id")) if known else self.spark.createDataFrame([], f"id {kind}, length int, {TERMS}, segment int")
        dead = self._write(lost.select("id", F.col("segment").alias("of")), "dead", number)
        lost = lost.join(dead.withColumnRenamed("of", "segment"), ["id", "segment"], "left_semi")
        figures = [x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first() for x in (new, lost)]
        each = new.select("id", "length", F.explode("terms").alias("t")).select("t.term", "id", "t.tf", "length", bucket_of(F.col("t.term"), self.buckets).alias("bucket"))
        self._write_postings(each, figures[0]["n"], number)
        added = new.select(F.explode("terms.term").alias("term"), F.lit(1).alias("one")).union(lost.select(F.explode("terms.term"), F.lit(-1)))
        self._write(added.groupBy("term").agg(F.sum("one").alias("added")).where("added <> 0"), "terms", number)
        base = max((r["base"] for r in known), default=0)
        commit = [(number, base, figures[0]["n"] - figures[1]["n"], figures[0]["tokens"] - figures[1]["tokens"])]
        self.spark.createDataFrame(commit, COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _in_force(self, ids: DataFrame) -> DataFrame:
        return self.rows().join(ids, "id", "left_semi").select("id", "length", "terms", "segment")

    def upsert(self, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", order_col: str | None = None) -> None:
        """Inserts rows, or replaces those of the same identifier."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        last = F.max_by("text", F.struct("order", "text")) if order_col else F.max("text")
        rows = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"), *([F.col(order_col).alias("order")] if order_col else []))
        # only the texts of repeated identifiers are gathered; of the others nothing is shuffled
        twice, at = written_at(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "twice")
        once = rows.join(twice, "id", "left_anti").select("id", "text")
        resolved = rows.join(twice, "id", "left_semi").groupBy("id").agg(last.alias("text"))
        self._segment(_counted(once.union(resolved)), self._in_force)
        remove(self.spark, at)

    def delete(self, ids: DataFrame, id_col: str = "chunk_id") -> None:
        """Puts the rows of these identifiers out of force."""
        if self.commits():
            none = self.spark.createDataFrame([], f"id {self._id()}, length int, {TERMS}")
            self._segment(none, lambda _: self._in_force(ids.select(F.col(id_col).alias("id"))))

    def merge(self) -> None:
        """Writes what is in force as one segment, out of the postings: nothing is tokenised again."""
        if not self.commits():
            return
        kind = self._id()
        live = self.postings().join(self.dead(), ["id", "segment"], "left_anti")
        number, totals = max(r["segment"] for r in self.commits()) + 1, self.totals()
        self._write_postings(live, totals[0], number)
        self._write(self.rows().select("id", "length", "terms"), "rows", number)
        self._write(self.spark.createDataFrame([], f"id {kind}, of int"), "dead", number)
        self._write(self.term_frequencies().select("term", F.col("df").alias("added")), "terms", number)
        self.spark.createDataFrame([(number, number, *totals)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def postings_of(self, terms: list[str]) -> DataFrame:
        """Postings in force of a few terms: their buckets' folders, and of these the row groups of the terms."""
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), self.buckets)).distinct().collect()]
        own = self.postings().where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return own.join(self.dead(), ["id", "segment"], "left_anti")

    def scores(self, query: str) -> DataFrame:
        """(id, score) of the rows that have a term of the query; a term counts as often as the query has it.

        The driver reads the query's tokens and a row a term. Only where a term is in over half the rows is
        the mean idf of the vocabulary needed, off the table of document frequencies.
        """
        commits = self.commits()
        tokens = self.spark.range(1).select(T.bm25_tokens(F.lit(query)).alias("tokens")).first()["tokens"]
        if not commits or not tokens:
            return self.spark.createDataFrame([], f"id {self._id() if commits else 'string'}, score double")
        terms = list(dict.fromkeys(tokens))
        n, length = self.totals()
        own = self.postings_of(terms)
        df = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
        if min(idf.values(), default=0) < 0:
            raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
            mean = self.term_frequencies().agg(F.avg(raw).alias("mean")).first()["mean"]
            idf = {t: EPSILON * mean if x < 0 else x for t, x in idf.items()}
        weight = reduce(lambda rest, t: F.when(F.col("term") == t, F.lit(tokens.count(t) * idf[t] * (K1 + 1))).otherwise(rest), idf, F.lit(0.0))
        norm = F.lit(1 - B) + F.lit(B * n / length if length else 0.0) * F.col("length")
        return own.groupBy("id").agg(F.sum(weight * F.col("tf") / (F.col("tf") + F.lit(K1) * norm)).alias("score"))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """The k best (id, score) by score, then identifier. Rows without a term of the query score 0, and are
        only looked at if fewer than k score above."""
        found = self.scores(query)
        best = found.orderBy(F.desc("score"), "id").limit(k)
        if self.commits() and best.where("score > 0").count() < k:
            others = self.rows().join(found.select("id"), "id", "left_anti").orderBy("id").limit(k).select("id", F.lit(0.0).alias("score"))
            best = found.unionByName(others).orderBy(F.desc("score"), "id").limit(k)
        return best
