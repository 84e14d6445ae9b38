"""Keeping an index of chunks: what is new, what is too like a stored one, and what the index then holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators import logs, memory
from siftmill.operators.neighbours import NeighbourIndex
from siftmill.sources.tables import new_path, written

# Fixed value: a chunk above this cosine with another counts as a duplicate.
DUPLICATE = 0.95


def index_chunks(
    stored: DataFrame, chunks: DataFrame, vector: str = "embedding", threshold: float = DUPLICATE, order: list[str] | None = None, index: NeighbourIndex | None = None
) -> tuple[DataFrame, DataFrame]:
    """The index after taking in ``chunks`` (chunk_id, source_file, vector, ...), and one row of counts.

    Chunks whose identifier is stored are skipped. The others are judged in the batch's order (``order``; where
    not given, source_file and ordinal as far as there are such columns; ties by chunk_id). One that is above
    the threshold with a stored chunk, or with an earlier one of the batch that is taken in, is a duplicate,
    and so is a second one of an identifier. ``index``, where given, is a kept inverted file of the stored
    vectors: then the work grows with the batch and the lists it reaches, and what is taken in is added to
    it. Without one it is built of ``stored``. Of the batch, equal vectors count once, as only the first can
    stay; the rest go through an inverted file of their own. Both tables have the same columns.
    """
    spark = chunks.sparkSession
    order = [c for c in ("source_file", "ordinal") if c in chunks.columns] if order is None else order
    place = F.struct(*order, "chunk_id")
    first = chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*[chunks[c] for c in chunks.columns]), place).alias("_row")).select("_row.*")
    new = logs.missing(chunks, stored, "chunk_id")
    fresh = written(logs.missing(first, stored, "chunk_id").withColumn("_place", place), "fresh")
    # an equal vector after the first is above the threshold with it, or goes with it
    usable = F.forall(F.col(vector), lambda x: x.isNotNull()) & F.exists(F.col(vector), lambda x: x != 0)
    heads = fresh.where(usable).groupBy(vector).agg(F.min("_place").alias("_place"))
    apart = written(fresh.join(heads.select("_place"), "_place", "left_semi"), "apart")
    index = index or NeighbourIndex(spark, new_path(spark, "neighbours")).build(stored, "chunk_id", vector)
    beaten = written(index.beaten(apart, threshold, "chunk_id", vector), "beaten")
    open_ = written(logs.missing(apart, beaten.select(F.col("query").alias("chunk_id")), "chunk_id"), "open")
    own = NeighbourIndex(spark, new_path(spark, "neighbours")).build(open_, "chunk_id", vector)
    near = own.above(open_, threshold, "chunk_id", vector).where("id <> query")
    places = open_.select("chunk_id", "_place")
    pairs = (
        near.join(places.select(F.col("chunk_id").alias("query"), F.col("_place").alias("b")), "query")
        .join(places.select(F.col("chunk_id").alias("id"), F.col("_place").alias("a")), "id").where("a < b").select("a", "b")
    )
    kept = memory.greedy_kept(places, pairs, "_place").where("kept").select("chunk_id")
    others = logs.missing(fresh.where(~F.coalesce(usable, F.lit(False))), kept, "chunk_id").select("chunk_id")
    taken = written(fresh.join(kept.union(others), "chunk_id", "left_semi").drop("_place"), "taken")
    index.add(taken, "chunk_id", vector)
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source_file").alias("sources"))
    came, added = new.agg(F.count(F.lit(1)).alias("new")), taken.agg(F.count(F.lit(1)).alias("added"))
    told = counts.crossJoin(came).crossJoin(added).select("sources", "chunks", (F.col("chunks") - F.col("new")).alias("skipped"), (F.col("new") - F.col("added")).alias("duplicates"), "added")
    return stored.unionByName(taken.select(stored.columns)), told


def chunks_in_order(chunks: DataFrame, prefix: str = "") -> DataFrame:
    """Chunks of sources that start with ``prefix``, by source (byte order), ordinal and identifier."""
    rows = chunks.where(F.col("source_file").startswith(prefix)) if prefix else chunks
    return rows.orderBy("source_file", "ordinal", "chunk_id")


def chunks_by_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks")).orderBy("source_file")


def copy_collection(source: DataFrame, target: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What ``target`` lacks of ``source``; rows of the target that the source hasn't raise an error first."""
    extra = logs.missing(target, source, key).limit(1).count()
    if extra or dict(source.dtypes) != dict(target.dtypes):
        raise ValueError("the target has rows or columns of another collection")
    return logs.missing(source, target, key)
