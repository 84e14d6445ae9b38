"""Log queries: events stand for tool calls of users as tasks, conversations for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import logs
from siftmill.sources.tables import read_table

STATUSES = ["success", "failure", "rejected", "rate_limited"]


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(k % 10 == 0, "rate_limited").when(k % 10 == 1, "rejected").when(k % 10 == 2, "failure").otherwise("success")
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("task"), F.col("event_type").alias("tool"), k.alias("k"), status.alias("status"), "value", F.to_date("ts").alias("day"), "ts"
    )


CALLS = """c AS (SELECT event_id, user_id AS task, event_type AS tool, k, CASE k % 10 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'rejected' WHEN 2 THEN 'failure' ELSE 'success' END AS status, value, ts::DATE AS day, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    refused = F.count_if(F.col("tool") == "error")
    n = F.count(F.lit(1))
    return _calls(spark, sf_dir).agg(
        n.alias("n"), refused.alias("refused"), F.round(F.try_divide(refused.cast("double"), n), 4).alias("refusal_rate"),
        F.round(F.sum("value"), 4).alias("total_cost"), F.round(F.avg("value"), 6).alias("mean_cost"), F.sum("k").alias("tokens"),
    )


STATS_SQL = f"""WITH {CALLS} SELECT count(*) AS n, count_if(tool = 'error')::BIGINT AS refused, round(count_if(tool = 'error') / count(*), 4) AS refusal_rate,
round(sum(value), 4) AS total_cost, round(avg(value), 6) AS mean_cost, CAST(sum(k) AS BIGINT) AS tokens FROM c"""


def cost_by_task_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of users by the set of tools that they called."""
    calls = _calls(spark, sf_dir)
    types = logs.task_types(calls, "task", "tool")
    costs = calls.groupBy("task").agg(F.sum("value").alias("usd"))
    typed = costs.join(types, "task", "left").groupBy(F.coalesce("type", F.lit("unplanned")).alias("type"))
    return typed.agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum("usd"), 4).alias("usd"), F.round(F.avg("usd"), 4).alias("avg_usd"))


TYPE_SQL = f"""WITH {CALLS}, t AS (SELECT task, array_to_string(list_sort(list(DISTINCT tool)), '+') AS type FROM c GROUP BY task),
u AS (SELECT task, sum(value) AS usd FROM c GROUP BY task)
SELECT coalesce(type, 'unplanned') AS type, count(*) AS tasks, round(sum(usd), 4) AS usd, round(avg(usd), 4) AS avg_usd FROM u LEFT JOIN t USING (task) GROUP BY 1"""


def expensive_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = _calls(spark, sf_dir).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("k").alias("tokens"), F.round(F.sum("value"), 4).alias("usd"))
    return agents.orderBy(F.desc("usd"), "tool")


AGENTS_SQL = f"WITH {CALLS} SELECT tool, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens, round(sum(value), 4) AS usd FROM c GROUP BY tool ORDER BY usd DESC, tool"


def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.usage(_calls(spark, sf_dir), "tool", "status", STATUSES)


USAGE_SQL = f"WITH {CALLS} SELECT tool, {', '.join(f"count_if(status = '{s}')::BIGINT AS {s}" for s in STATUSES)}, count(*) AS total FROM c GROUP BY tool"


def escalation_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: tasks, those with a call that was not admitted, and their share."""
    daily = _calls(spark, sf_dir).groupBy("day", "task").agg(F.bool_or(F.col("status") == "rejected").alias("escalated"))
    counts = daily.groupBy("day").agg(F.count(F.lit(1)).alias("tasks"), F.count_if("escalated").alias("escalated"))
    return counts.withColumn("rate", F.round(F.col("escalated") / F.col("tasks"), 3)).withColumn("day", F.col("day").cast("string"))


TREND_SQL = f"""WITH {CALLS}, d AS (SELECT day, task, bool_or(status = 'rejected') AS e FROM c GROUP BY ALL)
SELECT day::VARCHAR AS day, count(*) AS tasks, count_if(e)::BIGINT AS escalated, round(count_if(e) / count(*), 3) AS rate FROM d GROUP BY day"""


def traced_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 newest conversations with the cost of their user, 0 without one."""
    tasks = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    cost = _calls(spark, sf_dir).groupBy(F.col("task").alias("conv_id")).agg(F.sum("value").alias("usd"))
    newest = tasks.join(cost, "conv_id", "left").select("conv_id", "turns", F.round(F.coalesce("usd", F.lit(0.0)), 4).alias("usd"))
    return newest.orderBy(F.desc("conv_id")).limit(25)


TRACED_SQL = f"""WITH {CALLS}, t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id), u AS (SELECT task AS conv_id, sum(value) AS usd FROM c GROUP BY task)
SELECT conv_id, turns, round(coalesce(usd, 0), 4) AS usd FROM t LEFT JOIN u USING (conv_id) ORDER BY conv_id DESC LIMIT 25"""


def rate_limit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.over_limit(_calls(spark, sf_dir), "task", "tool", "status", ["ts", "event_id"], 10).select("event_id", "task", "tool", F.col("number").cast("long").alias("number"))


RATE_SQL = f"""WITH {CALLS}, n AS (SELECT event_id, task, tool, row_number() OVER (PARTITION BY task, tool ORDER BY ts, event_id) AS number FROM c WHERE status IN ('success', 'failure'))
SELECT * FROM n WHERE number > 10"""


def ceiling_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.over_ceiling(_calls(spark, sf_dir), "task", "value", ["ts", "event_id"], 60, 2000.0).select("event_id", "calls_before", F.round("cost_before", 4).alias("cost_before"))


CEILING_SQL = f"""WITH {CALLS}, b AS (SELECT event_id, count(*) OVER w AS calls_before, coalesce(sum(value) OVER w, 0) AS cost_before FROM c
  WINDOW w AS (PARTITION BY task ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, calls_before, round(cost_before, 4) AS cost_before FROM b WHERE calls_before >= 60 OR b.cost_before >= 2000"""


def repeat_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.repeat_share(_calls(spark, sf_dir), "task", ["tool", "k"]).select("task", "n", "repeats", F.round("share", 9).alias("share"))


REPEAT_SQL = f"""WITH {CALLS}, g AS (SELECT task, count(*) AS n FROM c GROUP BY task, tool, k)
SELECT task, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS repeats, round(sum(n - 1) / sum(n), 9) AS share FROM g GROUP BY task"""


def toolless_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task")).distinct()
    return logs.missing(tasks, _calls(spark, sf_dir).where("status = 'success' AND tool = 'purchase'"), "task")


TOOLLESS_SQL = f"WITH {CALLS} SELECT DISTINCT conv_id AS task FROM conversations WHERE conv_id NOT IN (SELECT task FROM c WHERE status = 'success' AND tool = 'purchase')"


def tool_call_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task: recall of the wanted tools (purchase, signup), precision of its calls and their error rate."""
    wanted = F.col("tool").isin("purchase", "signup")
    done = F.col("status") == "success"
    n = F.count(F.lit(1))
    return _calls(spark, sf_dir).groupBy("task").agg(
        F.round(F.count_distinct(F.when(wanted & done, F.col("tool"))) / F.lit(2.0), 9).alias("recall"),
        F.round(F.count_if(wanted) / n, 9).alias("precision"), F.round(F.count_if(~done) / n, 9).alias("error_rate"),
    )


SCORES_SQL = f"""WITH {CALLS} SELECT task, round(count(DISTINCT tool) FILTER (tool IN ('purchase', 'signup') AND status = 'success') / 2.0::DOUBLE, 9) AS recall,
round(count_if(tool IN ('purchase', 'signup')) / count(*), 9) AS precision, round(count_if(status <> 'success') / count(*), 9) AS error_rate FROM c GROUP BY task"""


def replay_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations against the odd ones after them: messages on both sides and on one."""
    turns = read_table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 2).alias("pair"), "conv_id", "turn", "role", "text")
    both = logs.aligned(turns.where("conv_id % 2 = 0"), turns.where("conv_id % 2 = 1"), "pair", "role", "text", "turn")
    left, right = F.col("in_left"), F.col("in_right")
    return both.groupBy("pair").agg(F.count_if(left & right).alias("matched"), F.count_if(left & ~right).alias("only_original"), F.count_if(~left & right).alias("only_fork"))


REPLAY_SQL = """WITH t AS (SELECT conv_id // 2 AS pair, conv_id % 2 AS side, role, text, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS k FROM conversations),
b AS (SELECT coalesce(l.pair, r.pair) AS pair, l.pair IS NOT NULL AS l, r.pair IS NOT NULL AS r FROM (SELECT * FROM t WHERE side = 0) l
  FULL JOIN (SELECT * FROM t WHERE side = 1) r ON l.pair = r.pair AND l.role = r.role AND l.text = r.text AND l.k = r.k)
SELECT pair, count_if(l AND r)::BIGINT AS matched, count_if(l AND NOT r)::BIGINT AS only_original, count_if(r AND NOT l)::BIGINT AS only_fork FROM b GROUP BY pair"""


def message_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.rendered(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


RENDER_SQL = "SELECT conv_id, string_agg('[' || role || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id"


def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    calls = _calls(spark, sf_dir).select("task", "tool", "event_id", "ts", "value")
    return logs.latest(calls, ["task", "tool"], F.struct("ts", "event_id")).select("task", "tool", "event_id", "value")


LATEST_SQL = f"WITH {CALLS} SELECT task, tool, event_id, value FROM c QUALIFY row_number() OVER (PARTITION BY task, tool ORDER BY ts DESC, event_id DESC) = 1"


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds stored, two thirds new with longer texts; what both have is overwritten."""
    rows = _collection(spark, sf_dir)
    return logs.upsert(rows.where("doc_id % 3 <> 2"), rows.where("doc_id % 3 <> 0").withColumn("n_chars", F.col("n_chars") + 1), "doc_id")


UPSERT_SQL = "SELECT doc_id, lang, coalesce(n_chars, 0) + CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END AS n_chars FROM documents"


def copy_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _collection(spark, sf_dir)
    return logs.missing(rows, rows.where("doc_id % 4 <> 1"), "doc_id")


COPY_SQL = "SELECT doc_id, lang, coalesce(n_chars, 0) AS n_chars FROM documents WHERE doc_id % 4 = 1"


def collection_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    return logs.collection_checksum(read_table(spark, sf_dir, "documents"), "doc_id", text)


CHECKSUM_SQL = """WITH a AS (SELECT doc_id, md5(doc_id::VARCHAR) AS node, sha256(doc_id || '|' || coalesce(text, '')) AS digest FROM documents),
b AS (SELECT left(node, 5) AS node, sha256(string_agg(digest, '' ORDER BY a.doc_id)) AS digest FROM a GROUP BY 1),
c AS (SELECT left(b.node, 2) AS node, sha256(string_agg(digest, '' ORDER BY b.node)) AS digest FROM b GROUP BY 1)
SELECT sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM c"""


def source_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered checksum of each source's documents."""
    text = F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    return logs.ordered_checksums(read_table(spark, sf_dir, "documents"), ["source"], "doc_id", text)


SOURCE_CHECKSUM_SQL = """SELECT source, count(*) AS n, sha256(unhex(string_agg(sha256(doc_id || '|' || coalesce(text, '')), '' ORDER BY doc_id))) AS digest FROM documents GROUP BY source"""


def memory_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events of a type as a memory: its importance on 2024-03-15 and whether it expires."""
    used = _calls(spark, sf_dir).groupBy("task", "tool").agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last"))
    age = F.date_diff(F.lit("2024-03-15").cast("date"), F.to_date("last")).cast("double")
    weight = logs.importance(F.col("accesses") / 10.0, age)
    return used.select("task", "tool", F.round(weight, 9).alias("importance"), ((weight < logs.MIN_IMPORTANCE) & (age > logs.EXPIRY_DAYS)).alias("expired"))


EXPIRE_SQL = f"""WITH {CALLS}, u AS (SELECT task, tool, count(*) AS n, max(ts) AS last FROM c GROUP BY ALL),
i AS (SELECT *, date_diff('day', last::DATE, DATE '2024-03-15') AS age FROM u), w AS (SELECT *, (1 + n / 10.0::DOUBLE) * pow(0.5::DOUBLE, age / 14.0::DOUBLE) AS w FROM i)
SELECT task, tool, round(w, 9) AS importance, w < 0.2 AND age > 30 AS expired FROM w"""


def topological_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a plan: each depends on the half of its key."""
    nodes = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    edges = nodes.where("id > 0").select("id", F.floor(F.col("id") / 2).alias("depends_on"))
    return logs.waves(nodes, edges)


WAVES_SQL = """WITH RECURSIVE w AS (SELECT n_nationkey AS id, 0 AS wave FROM nation
UNION ALL SELECT n.n_nationkey, w.wave + 1 FROM w JOIN nation n ON n.n_nationkey > 0 AND n.n_nationkey // 2 = w.id)
SELECT CAST(id AS BIGINT) AS id, max(wave) AS wave FROM w GROUP BY id"""

QUERIES = {
    f.__name__: f for f in (
        trace_stats, cost_by_task_type, expensive_agents, tool_usage, escalation_trend, traced_tasks, rate_limit_audit, ceiling_audit, repeat_calls, toolless_tasks,
        tool_call_scores, replay_alignment, message_render, latest_record, upsert_chunks, copy_missing, collection_checksum, source_checksums, memory_expire, topological_waves,
    )
}
ORACLES = {
    "trace_stats": STATS_SQL, "cost_by_task_type": TYPE_SQL, "expensive_agents": AGENTS_SQL, "tool_usage": USAGE_SQL, "escalation_trend": TREND_SQL,
    "traced_tasks": TRACED_SQL, "rate_limit_audit": RATE_SQL, "ceiling_audit": CEILING_SQL, "repeat_calls": REPEAT_SQL, "toolless_tasks": TOOLLESS_SQL,
    "tool_call_scores": SCORES_SQL, "replay_alignment": REPLAY_SQL, "message_render": RENDER_SQL, "latest_record": LATEST_SQL, "upsert_chunks": UPSERT_SQL,
    "copy_missing": COPY_SQL, "collection_checksum": CHECKSUM_SQL, "source_checksums": SOURCE_CHECKSUM_SQL, "memory_expire": EXPIRE_SQL, "topological_waves": WAVES_SQL,
}
