"""Runs of agents over the test tables: replays of conversations, attempts of subtasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import agents, replay
from siftmill.sources.tables import read_table


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as recorded runs and the one after each as its replay; the prompt is a text's length class."""
    turns = read_table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("agent"), (F.char_length("text") % 3).cast("string").alias("prompt"))
    return rows.withColumnRenamed("conv_id", "run"), rows.select((F.col("conv_id") - 1).alias("run"), "seq", "agent", "prompt")


def replay_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded, calls = _runs(spark, sf_dir)
    return replay.replayed(recorded, calls)


def replay_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded, calls = _runs(spark, sf_dir)
    return replay.divergence(replay.replayed(recorded, calls), recorded)


SERVED = """q AS (SELECT conv_id AS run, role AS agent, list({'seq': turn, 'p': length(text) % 3} ORDER BY turn) AS records FROM conversations GROUP BY ALL),
c AS (SELECT conv_id - 1 AS run, role AS agent, list({'seq': turn, 'p': length(text) % 3} ORDER BY turn) AS calls FROM conversations GROUP BY ALL),
b AS (SELECT c.run, c.agent, coalesce(records, []) AS records, calls FROM c LEFT JOIN q USING (run, agent)),
s AS (SELECT run, agent, records AS open, calls, 0 AS i, NULL::BIGINT AS seq, NULL::BIGINT AS served, false AS exact FROM b
  UNION ALL SELECT run, agent, CASE WHEN pick IS NULL THEN open ELSE list_filter(open, lambda x: x.seq <> pick) END, calls, i, seq, pick, hit FROM (
    SELECT run, agent, open, calls, i + 1 AS i, calls[i + 1].seq AS seq, len(list_filter(open, lambda x: x.p = calls[i + 1].p)) > 0 AS hit,
      coalesce(list_filter(open, lambda x: x.p = calls[i + 1].p)[1].seq, open[1].seq) AS pick FROM s WHERE i < len(calls))),
served AS (SELECT run, agent, seq, served, exact FROM s WHERE i > 0)"""
SERVED_SQL = f"WITH RECURSIVE {SERVED} SELECT * FROM served"
DIVERGENCE_SQL = f"""WITH RECURSIVE {SERVED}, t AS (SELECT run, count(*) AS n_calls, count_if(exact)::BIGINT AS n_exact, min(seq) FILTER (served IS NULL) AS diverged_at FROM served GROUP BY run),
u AS (SELECT conv_id AS run, min(turn) AS unused_at, arg_min(role, turn) AS unused_agent FROM conversations v WHERE NOT EXISTS (SELECT 1 FROM served x WHERE x.run = v.conv_id AND x.agent = v.role AND x.served = v.turn) GROUP BY conv_id)
SELECT run, coalesce(n_calls, 0) AS n_calls, coalesce(n_exact, 0)::BIGINT AS n_exact, diverged_at, unused_at, unused_agent FROM (SELECT DISTINCT conv_id AS run FROM conversations) LEFT JOIN t USING (run) LEFT JOIN u USING (run)"""


def attempt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a day as attempts at a subtask: errors fail, sign-ups are a person's approvals, the rest are reviewed by their value."""
    rows = read_table(spark, sf_dir, "events").where("value IS NOT NULL").select(
        F.col("user_id").alias("task"), F.date_format("ts", "yyyy-MM-dd").alias("sid"), "event_id",
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "approval").otherwise("reviewed").alias("kind"),
        F.least(F.lit(5), F.floor(F.col("value") / 40) + 1).cast("int").alias("score"), ((F.col("event_type") == "view") & (F.col("value") < 20)).alias("silent"),
    )
    return agents.attempt_states(rows, ["task", "sid"], ["event_id"]).drop("score", "silent")


ATTEMPTS_SQL = """WITH RECURSIVE e AS (SELECT user_id AS task, strftime(ts, '%Y-%m-%d') AS sid, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'approval' ELSE 'reviewed' END AS kind,
  least(5, floor(value / 40) + 1)::INT AS score, event_type = 'view' AND value < 20 AS silent, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL),
s AS (SELECT task, sid, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, 'new' AS status, 0::BIGINT AS attempts, 0::BIGINT AS error_count, 0::BIGINT AS rework_count, 3::BIGINT AS attempt_allowance, NULL::INT AS score, NULL::BOOLEAN AS silent
  FROM (SELECT DISTINCT task, sid FROM e)
  UNION ALL SELECT task, sid, e.i, e.event_id, e.kind, CASE WHEN s.status = 'completed' THEN 'completed' WHEN e.kind = 'failed' THEN 'failed_attempt' WHEN e.kind = 'approval' THEN 'approved' WHEN e.silent OR e.score < 3 THEN 'rework' ELSE 'completed' END,
    attempts + (s.status <> 'completed' AND e.kind <> 'approval')::BIGINT, error_count + (s.status <> 'completed' AND e.kind = 'failed')::BIGINT, rework_count + (s.status <> 'completed' AND e.kind = 'reviewed' AND (e.silent OR e.score < 3))::BIGINT,
    attempt_allowance + (s.status <> 'completed' AND e.kind = 'approval')::BIGINT, e.score, e.silent
  FROM s JOIN e USING (task, sid) WHERE e.i = s.i + 1)
SELECT task, sid, event_id, kind, status, attempts, error_count, rework_count, attempt_allowance, CASE WHEN status = 'failed_attempt' AND (error_count >= 2 OR attempts >= attempt_allowance) THEN 'specialist_double_failure'
  WHEN status = 'rework' AND (rework_count >= 2 OR attempts >= attempt_allowance) THEN 'low_review_score' END AS trigger FROM s WHERE i > 0"""

QUERIES = {f.__name__: f for f in (replay_served, replay_divergence, attempt_states)}
ORACLES = {"replay_served": SERVED_SQL, "replay_divergence": DIVERGENCE_SQL, "attempt_states": ATTEMPTS_SQL}
