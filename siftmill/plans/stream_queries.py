"""Event streams read up once; the SQL is of the rows that a watermark an hour behind lets go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.streaming import events


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.drained(events.tumbling(events.event_stream(spark, sf_dir)), "tumbling")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


TUMBLING_SQL = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL"""


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.drained(events.sessions(events.event_stream(spark, sf_dir)), "sessions")
    return rows.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


SESSION_SQL = """WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l),
g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 12 HOUR AS b, count(*) AS n FROM s GROUP BY user_id, s)
SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, n FROM g WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.drained(events.first_of_day(events.event_stream(spark, sf_dir)), "first-of-day")
    return rows.select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"))


DEDUP_SQL = "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events"

QUERIES = {f.__name__: f for f in (stream_tumbling, stream_session, stream_dedup)}
ORACLES = {"stream_tumbling": TUMBLING_SQL, "stream_session": SESSION_SQL, "stream_dedup": DEDUP_SQL}
