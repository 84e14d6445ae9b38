"""An append sink that a batch run twice writes to once, and rows with the defaults of a trace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def idempotent_append(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Appends what the stream holds now to ``path``, and returns the ended query.

    A micro-batch goes to a folder of its own number, which a second run of the batch replaces: a batch that
    failed between its write and Spark's note of it is written once. ``prepare`` turns a batch's rows into
    those of the sink (aggregates too); ``after`` is called when a batch is written. Batch numbers belong to a
    checkpoint, so a path has one checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the sink, without the batch's number."""
    return spark.read.schema(f"{schema}, batch long").parquet(path).drop("batch")


#: What a trace has where the caller gives nothing (name, kind, default).
TRACE = (
    ("question", "string", ""), ("mode", "string", "dense"), ("refused", "boolean", False), ("confidence", "double", 0.0),
    ("prompt_tokens", "long", 0), ("completion_tokens", "long", 0), ("cost_usd", "double", 0.0),
)


def trace_rows(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of the trace table: columns that are missing or NULL take their default, ``ts`` is now, ``timings_ms`` an empty map."""
    own = lambda name, kind, default: F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in rows.columns else F.lit(default).cast(kind)
    none = F.create_map().cast("map<string,double>")
    ts = now if now is not None else F.current_timestamp()
    return rows.select(
        (F.coalesce(F.col("ts").cast("timestamp"), ts) if "ts" in rows.columns else ts).alias("ts"), *[own(*t).alias(t[0]) for t in TRACE],
        (F.coalesce(F.col("timings_ms").cast("map<string,double>"), none) if "timings_ms" in rows.columns else none).alias("timings_ms"),
    )
