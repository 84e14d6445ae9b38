"""Exact deduplication with a log-structured merge index of text digests.

Every text is hashed once and its identifier and digest written. These rows are dealt into memtables of
bounded size. A memtable flushes to one run: one file, a row a digest with the least and the largest
identifier and the number of rows, sorted by digest, and a bit filter of the digests it has. Compaction
probes the filters first: a digest that is in no other run's filter has met all its rows in its own
memtable and passes as it is; the others are merged, and the identifier to keep stays. (With more digests
than the filters' bound has bits for, nearly all would be merged anyway, and all are.) Rows of repeated
digests are hits: another filter, of their identifiers, tells which texts leave the scan, and hits of one
digest are compared byte by byte. Rows whose digest agrees but whose bytes differ are regrouped by bytes.

Everything is DataFrame code: no Python function runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.storage import ascii_lower, documents, new_path, written, written_at

#: Rows of a memtable at most and at least, on average; a row takes 40 bytes, so a task that sorts one needs
#: tens of megabytes. Between the two there is a memtable for each shuffle partition.
MEMTABLE_ROWS, LEAST_ROWS = 1 << 20, 1 << 12
#: Bits a filter has for each entry, as a power of two at or above it, and in all at most: 32 MB to broadcast.
#: Past that more rows pass that needn't, up to all of them; results don't change.
BITS_PER_ENTRY, MOST_BITS = 16, 1 << 28
#: Bits of one bitmap of Spark's bitmap functions.
_CHUNK = 32768


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def filter_bits(entries: int) -> int:
    return min(MOST_BITS, max(_CHUNK, 1 << (BITS_PER_ENTRY * entries - 1).bit_length())) if entries else _CHUNK


def bit_filter(rows: DataFrame, key: Column, bits: int, *by: str) -> DataFrame:
    """(by..., bucket, bitmap): a bit of the hashed key set; at most ``bits`` / 8 bytes a group."""
    position = F.pmod(F.xxhash64(key), F.lit(bits))
    return rows.groupBy(*by, F.bitmap_bucket_number(position).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bitmap"))


def probed(rows: DataFrame, key: Column, bitmaps: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with boolean ``name``: whether the key's bit is set. The filter's size is bounded, so it is broadcast."""
    position = F.pmod(F.xxhash64(key), F.lit(bits))
    bit = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.broadcast(bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")))
    joined = rows.join(held, F.bitmap_bucket_number(position) == F.col("_bucket"), "left")
    joined = joined.withColumn("_byte", F.coalesce(byte, F.lit(0))).withColumn("_bit", (bit % 8).cast("int"))
    return joined.withColumn(name, F.expr("(shiftright(_byte, _bit) & 1) = 1")).drop("_bucket", "_bitmap", "_byte", "_bit")


class DigestIndex:
    """The merge index: sorted runs with their filters under one folder, and what compaction makes of them."""

    def __init__(self, spark, path: str, keep: str = "smallest"):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep must be 'smallest' or 'largest'")
        self.spark, self.path, self.keep = spark, path, keep
        self.runs, self.n = None, 0  # the runs' schema, so that an index without rows can be read, and their number

    def flush(self, rows: DataFrame, memtables: int) -> None:
        """Writes (digest, id) rows as ``memtables`` runs of one sorted file each, numbered after those there are.

        Rows are dealt by a hash of identifier and digest, so copies by the million are spread over the runs.
        """
        run = (F.pmod(F.xxhash64("id", "digest"), F.lit(memtables)) + self.n).cast("int")
        dealt = rows.withColumn("run", run).repartition("run")
        table = dealt.groupBy("run", "digest").agg(F.min("id").alias("least"), F.max("id").alias("largest"), F.count(F.lit(1)).alias("n"))
        self.runs, self.n = table.schema, self.n + memtables
        (
            table.sortWithinPartitions("run", "digest").write.mode("append").partitionBy("run")
            .option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", str(MEMTABLE_ROWS))
            .parquet(f"{self.path}/level0")
        )

    def shared(self, level: DataFrame, bits: int) -> DataFrame:
        """The bits that the filters of more than one run have, as a filter.

        A run's filter sets a digest's bit once, so a bit is counted over (run, bit) pairs.
        """
        position = F.pmod(F.xxhash64("digest"), F.lit(bits))
        filters = level.select("run", position.alias("position")).groupBy("position").agg(F.min("run").alias("a"), F.max("run").alias("b"))
        several = filters.where("a <> b")
        return several.groupBy(F.bitmap_bucket_number("position").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bitmap"))

    def compact(self) -> DataFrame:
        """(digest, keep_id, group_size): all runs merged; of equal digests the kept identifier stays."""
        kept = F.min("least") if self.keep == "smallest" else F.max("largest")
        level = self.spark.read.schema(self.runs).parquet(f"{self.path}/level0")
        own = F.col("least" if self.keep == "smallest" else "largest")
        entries = level.count()
        if self.n > 1 and 2 * entries <= MOST_BITS:
            bits = filter_bits(entries)
            marked = probed(level, F.col("digest"), self.shared(level, bits), bits, "_elsewhere")
            merged = marked.where("_elsewhere").groupBy("digest").agg(kept.alias("keep_id"), F.sum("n").alias("group_size"))
            table = marked.where("NOT _elsewhere").select("digest", own.alias("keep_id"), F.col("n").alias("group_size")).union(merged)
        elif self.n > 1:
            table = level.groupBy("digest").agg(kept.alias("keep_id"), F.sum("n").alias("group_size"))
        else:
            table = level.select("digest", own.alias("keep_id"), F.col("n").alias("group_size"))
        table.write.mode("overwrite").parquet(f"{self.path}/level1")
        return self.spark.read.schema(table.schema).parquet(f"{self.path}/level1")


def _digests(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column], digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), digest(normalise(F.coalesce(F.col(text_col), F.lit("")))).alias("digest"))


def _hit_filter(keys: DataFrame, several: DataFrame) -> tuple[DataFrame, int]:
    """A written filter of the identifiers of rows with a repeated digest, and its bits."""
    total = several.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    bits = filter_bits(int(total))
    # the filter's keys combine before they shuffle, and a hot digest's rows are split by the join
    return written(bit_filter(keys.join(several.select("digest"), "digest", "left_semi"), F.col("id"), bits), "hits"), bits


def _indexed(docs, id_col, text_col, keep, memtables, normalise, digest, path):
    """The written (id, digest) rows, the merged groups and the groups of more than one row."""
    spark = docs.sparkSession
    keys = written(_digests(docs, id_col, text_col, normalise, digest), "digests")
    index = DigestIndex(spark, path or new_path(spark, "lsm"), keep)
    if memtables is None:
        rows, tasks = keys.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
        memtables = max(1, min(tasks, -(-rows // LEAST_ROWS)), -(-rows // MEMTABLE_ROWS))
    index.flush(keys, memtables)
    merged = index.compact()
    return keys, merged, merged.where("group_size > 1")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtables: int | None = None,
    normalise: Callable[[Column], Column] = ascii_lower, digest: Callable[[Column], Column] = sha256_digest, path: str | None = None,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when their normalised bytes are; NULL counts as empty, and long texts are hashed whole.
    ``keep`` says which identifier of a group stays; rows that repeat an identifier and text all count in
    group_size and all are kept if the identifier is. A NULL identifier joins its text's group and is
    verified like any row; it is never the one that stays unless the group has no other (keep_id is then
    NULL, and kept true). An empty table gives an empty result. Other columns are not read. ``memtables``
    is the number of runs.
    """
    keys, merged, several = _indexed(docs, id_col, text_col, keep, memtables, normalise, digest, path)
    hits, bits = _hit_filter(keys, several)

    # the texts of possible hits: equal bytes are those whose least and largest are equal, so copies combine
    # before the shuffle and a group of any size sends one text a task
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = probed(own, F.col("id"), hits, bits, "_hit").where("_hit").select("id", normalise(F.coalesce("text", F.lit(""))).alias("text"))
    texts = texts.select("id", "text", digest(F.col("text")).alias("digest"))
    differ = written(
        texts.groupBy("digest").agg(F.min("text").alias("first"), F.max("text").alias("last")).where(F.col("first") != F.col("last")).select("digest"), "collisions"
    )
    joined = keys.join(merged, "digest", "left").select("id", "digest", "keep_id", "group_size")
    if not differ.isEmpty():
        kept = F.min("id") if keep == "smallest" else F.max("id")
        rows = texts.join(differ, "digest", "left_semi")
        groups = rows.groupBy("digest", "text").agg(kept.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        regrouped = rows.join(groups, ["digest", "text"]).select("id", "digest", "keep_id", "group_size")
        joined = joined.join(differ, "digest", "left_anti").unionByName(regrouped)
    return joined.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; rows with equal identifier and text stay once.

    Rows of a text that no other row has don't leave the scan; only possible copies are shuffled. NULL
    identifiers are one identifier: of a text that only has those, one row stays. An empty table gives an
    empty result. Columns may have any names.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked, marked_at = written_at(exact_dedup(whole.select("id", "text"), "id", "text", keep), "marked")
    repeated = marked.where("group_size > 1")
    bits = filter_bits(repeated.count())
    hits = written(bit_filter(repeated, F.col("id"), bits), "hits")
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    stays = repeated.where("kept").select(key.alias("key"), F.col("text_sha256").alias("sha"))
    told = probed(whole, F.col("id"), hits, bits, "hit")
    maybe = told.where("hit").select("row", key.alias("key"), sha256_digest(ascii_lower(F.col("text"))).alias("sha"))
    alone = maybe.join(repeated.select(key.alias("key"), F.col("text_sha256").alias("sha")), ["key", "sha"], "left_anti").select("row")
    once = maybe.join(stays, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"]).select("row")
    return told.where("NOT hit").select("row").union(alone).union(once).select("row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the largest doc_id stays."""
    return exact_dedup(documents(spark, sf_dir, "doc_id", "text"), keep="largest")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)"""
