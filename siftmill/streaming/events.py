"""Event streams: tumbling windows, sessions and duplicates under a watermark.

Each function takes a streaming (or batch) DataFrame and returns one; :func:`drained` runs a stream over
what its source holds now. In append mode a window is sent once the watermark has passed its end; rows
later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.sources.tables import read_table, new_path

DELAY = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; ``ts`` becomes a TIMESTAMP, which watermarks need.

    The path is a pattern of one name, since a stream takes a folder or a pattern and the table may be a file.
    """
    schema = read_table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", delay: str = DELAY) -> DataFrame:
    """(window_start, event_type, n, total) of each closed window; rows without a time are in none."""
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", delay: str = DELAY) -> DataFrame:
    """(user_id, session_start, session_end, n) of each closed session; it ends a gap after its last event."""
    grouped = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_of_day(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """(user_id, event_type, day): each once, however often it comes before the watermark passes the day."""
    dated = events.withColumn("day", F.window("ts", "1 day").start)
    return dated.withWatermark("day", delay).dropDuplicates(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream appends until its source is read up, written to the shared folder and read back."""
    spark = stream.sparkSession
    at, state = new_path(spark, name), new_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(at)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)
