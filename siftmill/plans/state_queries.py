"""Keyed state over the events: users stand for tasks, events for writes and calls; errors are errors.

A watermark an hour behind the last event lets go what is older; the SQL is of those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.plans.log_queries import CALLS
from siftmill.sources.tables import new_path, read_table
from siftmill.streaming import events, sinks, state

TTL = 12 * 3600
MAX_CALLS, MAX_COST, LIMIT = 60, 2000.0, 10


def _field():
    return F.when(F.col("event_type") != "error", F.col("event_type")).alias("field")


def stream_working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each write: since when the user's memory lives, its fields and its errors."""
    writes = events.event_stream(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("task"), _field())
    return events.drained(state.working_memory(writes, TTL), "working-memory")


PASSED = "epoch_us(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events) * 1000"
LIVES = f"""l AS (SELECT event_id, user_id AS task, ts, value, CASE WHEN event_type <> 'error' THEN event_type END AS field,
  CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {TTL}000000, true) THEN epoch_us(ts) END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, max(first) OVER (PARTITION BY task ORDER BY ts, event_id) AS started FROM l)"""
MEMORY_SQL = f"""WITH {LIVES}, n AS (SELECT *, row_number() OVER (PARTITION BY task, started, field ORDER BY ts, event_id) AS i FROM s)
SELECT task, event_id, started, sum((field IS NOT NULL AND i = 1)::BIGINT) OVER w::BIGINT AS n_fields, sum((field IS NULL)::BIGINT) OVER w::BIGINT AS n_errors
FROM n WHERE {PASSED} WINDOW w AS (PARTITION BY task, started ORDER BY ts, event_id)"""


def working_memory_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the users' memories hold on the 20th at noon."""
    writes = read_table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("task"), _field(), "value")
    return state.memory_snapshot(writes, 1_705_752_000_000_000, TTL)


SNAPSHOT_SQL = f"""WITH {LIVES}, e AS (SELECT * FROM s WHERE epoch_us(ts) <= 1705752000000000), a AS (SELECT task, max(started) AS started FROM e GROUP BY task HAVING epoch_us(max(ts)) + {TTL}000000 > 1705752000000000)
SELECT task, field, arg_max(value, (ts, event_id)) AS value, NULL::INT AS place FROM e JOIN a USING (task, started) WHERE field IS NOT NULL GROUP BY task, field
UNION ALL SELECT task, NULL, value, row_number() OVER (PARTITION BY task ORDER BY ts, event_id) FROM e JOIN a USING (task, started) WHERE field IS NULL"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(k % 10 == 0, "rate_limited").when(k % 10 == 1, "rejected").when(k % 10 == 2, "failure").otherwise("success")
    return events.event_stream(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("task"), F.col("event_type").alias("tool"), status.alias("status"), F.col("value").alias("cost"))


def stream_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls that a ceiling of calls or cost refuses."""
    told = events.drained(state.ceilings(_calls(spark, sf_dir), MAX_CALLS, MAX_COST), "ceilings")
    return told.where("NOT admitted").select("event_id", "task")


CEILINGS_SQL = f"""WITH {CALLS}, b AS (SELECT event_id, task, ts, count(*) OVER w AS n, coalesce(sum(value) OVER w, 0) AS spent FROM c
  WINDOW w AS (PARTITION BY task ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, task FROM b WHERE (n >= {MAX_CALLS} OR spent >= {MAX_COST}) AND {PASSED}"""


def stream_rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executed calls beyond the limit of a user and tool."""
    told = events.drained(state.rate_limits(_calls(spark, sf_dir), LIMIT), "limits")
    return told.select("event_id", "task", "tool", "executed_before", "admitted")


LIMITS_SQL = f"""WITH {CALLS}, b AS (SELECT event_id, task, tool, ts, least({LIMIT}, coalesce(sum((status IN ('success', 'failure'))::BIGINT) OVER w, 0))::BIGINT AS executed_before FROM c
  WINDOW w AS (PARTITION BY task, tool ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, task, tool, executed_before, executed_before < {LIMIT} AS admitted FROM b WHERE {PASSED}"""


def stream_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events appended as traces by the sink, and its figures by mode."""
    rows = events.event_stream(spark, sf_dir).select("ts", F.col("event_type").alias("mode"), (F.col("event_type") == "error").alias("refused"), F.col("value").alias("cost_usd"))
    path = new_path(spark, "traces")
    sinks.idempotent_append(rows, path, new_path(spark, "traces-state"), sinks.trace_rows)
    kept = sinks.appended(spark, path, "ts timestamp, question string, mode string, refused boolean, confidence double, prompt_tokens long, completion_tokens long, cost_usd double")
    return kept.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("refused").alias("refused"), F.round(F.sum("cost_usd"), 4).alias("usd"), F.sum("prompt_tokens").alias("tokens"))


TRACES_SQL = """SELECT event_type AS mode, count(*) AS n, count_if(event_type = 'error')::BIGINT AS refused, round(sum(value), 4) AS usd, 0::BIGINT AS tokens FROM events GROUP BY 1"""

QUERIES = {f.__name__: f for f in (stream_working_memory, working_memory_snapshot, stream_ceilings, stream_rate_limits, stream_traces)}
ORACLES = {
    "stream_working_memory": MEMORY_SQL, "working_memory_snapshot": SNAPSHOT_SQL, "stream_ceilings": CEILINGS_SQL, "stream_rate_limits": LIMITS_SQL, "stream_traces": TRACES_SQL,
}
