"""Documents as sources of a corpus and questions of an ablation, events as requests to people and spans of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import budgets, reports, reviews
from siftmill.sources.tables import read_table

_TRIGGERS = ("low_plan_confidence", "user_requested", "sensitive_operation", "specialist_double_failure", "low_review_score")


def _pick(x, *names):
    return F.element_at(F.array(*map(F.lit, names)), (x % len(names) + 1).cast("int"))


def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories and documents of the corpus that a listing of 3,600 characters shows."""
    rows = read_table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"), (F.floor(F.char_length("text") / 1000) + 1).alias("chunks"))
    one = budgets.fitted_sources(rows)
    told = lambda c: F.explode(F.col(c)).alias("_e")
    files = one.select("shown", "of", "total_chunks", told("sources")).select(F.lit("source").alias("kind"), F.col("_e.source_file").alias("name"), F.lit(1).cast("long").alias("documents"), F.col("_e.chunks").alias("chunks"), "shown", "of", "total_chunks")
    folders = one.select("shown", "of", "total_chunks", told("directories")).select(F.lit("directory").alias("kind"), F.col("_e.directory").alias("name"), F.col("_e.documents").alias("documents"), F.col("_e.chunks").alias("chunks"), "shown", "of", "total_chunks")
    return files.union(folders)


LISTING_SQL = """WITH f AS (SELECT coalesce(source || '/' || lang || '/' || doc_id || '.md', '') AS name, coalesce(length(text) // 1000 + 1, 0) AS chunks FROM documents),
w AS (SELECT *, length('{"source_file": "", "chunks": }') + length(name) + length(chunks::VARCHAR) + 2 AS w FROM f),
a AS (SELECT count(*) AS n, CAST(sum(chunks) AS BIGINT) AS chunks, length('{"sources": [], "truncated": {"shown": , "of": }, "total_chunks": , "directories": []}') + length(count(*)::VARCHAR) + length(sum(chunks)::VARCHAR) AS frame,
  length('{"sources": [], "truncated": null, "total_chunks": , "directories": null}') + length(sum(chunks)::VARCHAR) + sum(w) - 2 <= 3600 AS whole FROM w),
d AS (SELECT regexp_extract(name, '^.+/') AS name, count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks FROM f GROUP BY 1),
e AS (SELECT *, sum(length('{"directory": "", "documents": , "chunks": }') + length(name) + length(documents::VARCHAR) + length(chunks::VARCHAR) + 2) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) - 2 AS used FROM d),
g AS (SELECT e.* FROM e, a WHERE frame + 1 + used <= 3600),
p AS (SELECT name, chunks, row_number() OVER o AS place, sum(w) OVER o - 2 AS used FROM w WINDOW o AS (ORDER BY name ROWS UNBOUNDED PRECEDING)),
s AS (SELECT p.name, p.chunks FROM p, a WHERE whole OR (place < n AND frame + coalesce((SELECT max(used) FROM g), 0) + length(place::VARCHAR) + used <= 3600)),
t AS (SELECT CASE WHEN NOT whole THEN (SELECT count(*) FROM s) END::INTEGER AS shown, n AS "of", chunks AS total_chunks, whole FROM a)
SELECT 'source' AS kind, name, 1::BIGINT AS documents, chunks, shown, "of", total_chunks FROM s, (SELECT shown, "of", total_chunks FROM t)
UNION ALL SELECT 'directory', name, documents, chunks, shown, "of", total_chunks FROM g, (SELECT shown, "of", total_chunks FROM t WHERE NOT whole)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    trigger = _pick(e, *_TRIGGERS)
    return read_table(spark, sf_dir, "events").select(
        e.cast("string").alias("approval_id"), F.col("user_id").cast("string").alias("task"), F.concat(F.lit("subtask:"), "event_type").alias("gate"), trigger.alias("trigger"),
        reviews.level(trigger, {"low_review_score": "notify"}).alias("level"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = "approval_id string, task string, gate string, trigger string, level string, created_at timestamp, status string, action string, resolved_at timestamp, review_seconds double"
    requests = _requests(spark, sf_dir)
    waiting = reviews.opened(spark.createDataFrame([], none), requests)
    number = F.col("approval_id").cast("long")
    answers = requests.where(number % 3 > 0).select(
        "approval_id", _pick(number, "approve", "reject", "take_over").alias("action"), F.timestamp_add("SECOND", (number % 600).cast("int"), F.col("created_at")).alias("at"))
    return reviews.resolved(waiting, answers)


APPROVALS = f"""r AS (SELECT event_id, user_id::VARCHAR AS task, 'subtask:' || event_type AS gate, {list(_TRIGGERS)}[event_id % 5 + 1] AS trigger,
  ['approve_plan', 'approve_plan', 'approve_action', 'approve_action', 'notify'][event_id % 5 + 1] AS level, ts FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY task, gate ORDER BY ts, event_id::VARCHAR) = 1),
p AS (SELECT event_id::VARCHAR AS approval_id, task, gate, trigger, level,
  CASE WHEN level = 'notify' THEN 'notified' WHEN event_id % 3 > 0 THEN 'resolved' ELSE 'pending' END AS status,
  CASE WHEN level <> 'notify' AND event_id % 3 > 0 THEN ['approve', 'reject', 'take_over'][event_id % 3 + 1] END AS action,
  CASE WHEN level <> 'notify' AND event_id % 3 > 0 THEN (event_id % 600)::DOUBLE END AS review_seconds FROM f)"""


def approval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approvals(spark, sf_dir).drop("created_at", "resolved_at")


APPROVALS_SQL = f"WITH {APPROVALS} SELECT * FROM p"


def review_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.review_times(_approvals(spark, sf_dir)).withColumn("mean_seconds", F.round("mean_seconds", 6))


TIMES_SQL = f"WITH {APPROVALS} SELECT trigger, level, count(*) AS n, count(*) FILTER (status = 'pending') AS pending, round(avg(review_seconds), 6) AS mean_seconds FROM p GROUP BY ALL"


def answer_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("approval_id").cast("long")
    waiting = _requests(spark, sf_dir).select(
        "approval_id", _pick(number, "plan", "final", "subtask:a", "tool:b").alias("gate"), F.when(number % 7 > 0, "pending").otherwise("resolved").alias("status"))
    answers = waiting.select(
        F.when(number % 11 > 0, F.col("approval_id")).otherwise("none").alias("approval_id"), _pick(F.floor(number / 4), "approve", "modify", "take_over").alias("action"),
        F.when(number % 2 == 0, F.create_map(F.lit("final_output"), F.lit("x"), F.lit("output"), F.lit(""))).alias("payload"),
    )
    return reviews.answer_findings(waiting, answers)


FINDINGS_SQL = """WITH a AS (SELECT event_id AS e, ['plan', 'final', 'subtask:a', 'tool:b'][event_id % 4 + 1] AS gate, ['approve', 'modify', 'take_over'][event_id // 4 % 3 + 1] AS action FROM events),
b AS (SELECT *, CASE WHEN action = 'take_over' AND gate IN ('plan', 'final') THEN 'final_output' WHEN action = 'take_over' AND gate = 'subtask:a' THEN 'output' WHEN action = 'modify' AND gate = 'plan' THEN 'plan'
  WHEN action = 'modify' AND gate = 'final' THEN 'final_output' WHEN action = 'modify' AND gate = 'tool:b' THEN 'arguments' END AS needs FROM a),
c AS (SELECT CASE WHEN e % 11 = 0 THEN 'none' ELSE e::VARCHAR END AS approval_id, CASE WHEN e % 11 = 0 THEN 'unknown approval' WHEN e % 7 = 0 THEN 'is resolved'
  WHEN needs IS NOT NULL AND NOT (needs = 'final_output' AND e % 2 = 0) THEN action || ' needs ' || needs END AS finding FROM b)
SELECT * FROM c WHERE finding IS NOT NULL"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    attributes = F.map_filter(F.create_map(
        F.lit("orchestrator.task_id"), F.when(e % 10 > 0, F.col("user_id").cast("string")), F.lit("orchestrator.kind"), F.when(e % 4 == 0, "review"),
        F.lit("orchestrator.status"), F.when(e % 9 == 0, "skipped"), F.lit("sid"), F.col("event_type"), F.lit("score"), (e % 6).cast("string"), F.lit("feedback"), F.concat(F.lit("f"), e.cast("string")),
    ), lambda _, v: v.isNotNull())
    start = F.col("ts").cast("timestamp")
    return read_table(spark, sf_dir, "events").select(
        F.format_string("%016x", e).alias("span_id"), F.lit("t").alias("trace_id"), F.lit(None).cast("string").alias("parent_id"), F.col("event_type").alias("name"), (e % 5 == 0).alias("error"),
        attributes.alias("attributes"), start.alias("start_time"), F.timestamp_add("SECOND", (e % 60).cast("int"), start).alias("end_time"),
    )


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.span_rows(_spans(spark, sf_dir)).select("span_id", "task_id", "name", "kind", "agent", "status", F.size("attributes").alias("n_attributes"), "duration_ms")


SPANS_SQL = """SELECT lower(printf('%016x', event_id)) AS span_id, user_id::VARCHAR AS task_id, event_type AS name, CASE WHEN event_id % 4 = 0 THEN 'review' ELSE 'node' END AS kind, NULL::VARCHAR AS agent,
CASE WHEN event_id % 9 = 0 THEN 'skipped' WHEN event_id % 5 = 0 THEN 'failure' ELSE 'success' END AS status, (2 + CASE WHEN event_type IS NULL THEN 0 ELSE 1 END)::INTEGER AS n_attributes, (event_id % 60 * 1000)::DOUBLE AS duration_ms
FROM events WHERE event_id % 10 > 0 AND user_id IS NOT NULL"""


def span_review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reviews.review_scores(reviews.span_rows(_spans(spark, sf_dir)))
    return found.select("task_id", "sid", F.array_join(F.col("scores").cast("array<string>"), ",").alias("scores"), F.array_join("rejected", ",").alias("rejected"))


SCORES_SQL = """SELECT user_id::VARCHAR AS task_id, event_type AS sid, string_agg((event_id % 6)::VARCHAR, ',' ORDER BY ts, event_id) AS scores,
coalesce(string_agg('f' || event_id, ',' ORDER BY ts, event_id) FILTER (event_id % 6 IN (1, 2)), '') AS rejected
FROM events WHERE event_id % 10 > 0 AND event_id % 4 = 0 AND user_id IS NOT NULL GROUP BY ALL"""


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a question that three arms searched; metrics and times follow from its number and length."""
    d, arm = F.col("doc_id"), F.col("arm")
    own = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.char_length("text").alias("n"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("arm"))
    return own.where((d + arm) % 10 > 0).select(
        d.alias("id"), _pick(d, "dev", "test").alias("split"), _pick(arm, "hybrid", "dense", "sparse").alias("arm"), "lang", ((d * (arm + 3)) % 5 / 4).alias("recall"),
        (F.lit(1.0) / (1 + (d + arm) % 4)).alias("mrr"), (F.col("n") % 997 + arm).cast("double").alias("total_ms"), F.when(arm == 0, (d % 50).cast("double")).alias("rerank_ms"),
    )


def ablation_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rounded(reports.ablation_arms(_ablation(spark, sf_dir), ["recall", "mrr"], ["total_ms", "rerank_ms"]))


ABLATION = """q AS (SELECT doc_id AS id, lang, a, ['dev', 'test'][doc_id % 2 + 1] AS split, ['hybrid', 'dense', 'sparse'][a + 1] AS arm, (doc_id * (a + 3)) % 5 / 4 AS recall, 1.0::DOUBLE / (1 + (doc_id + a) % 4) AS mrr,
  (length(text) % 997 + a)::DOUBLE AS total_ms, CASE WHEN a = 0 THEN (doc_id % 50)::DOUBLE END AS rerank_ms FROM documents, (VALUES (0), (1), (2)) v(a) WHERE (doc_id + a) % 10 > 0)"""
_RANK = "list_sort(list({0}) FILTER ({0} IS NOT NULL))[(count({0}) * {1} + 99) // 100] AS {0}_p{1}"
ARMS_SQL = f"""WITH {ABLATION} SELECT split, arm, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr,
{', '.join(_RANK.format(c, p) for c in ('total_ms', 'rerank_ms') for p in (50, 95))} FROM q GROUP BY split, arm"""


def ablation_mean_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the intervals are of, by stratum: numbers and means of the differences to the reference arm."""
    found = reports.ablation_differences(_ablation(spark, sf_dir), "hybrid", ["recall", "mrr"], "lang")
    return found.groupBy("split", "arm", "stratum", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("difference"), 9).alias("mean"))


DIFFERENCES_SQL = f"""WITH {ABLATION}, m AS (SELECT id, split, arm, lang, 'recall' AS metric, recall AS v FROM q UNION ALL SELECT id, split, arm, lang, 'mrr', mrr FROM q),
x AS (SELECT m.split, m.arm, m.lang, m.metric, m.v - r.v AS x FROM m JOIN m r ON m.id = r.id AND m.metric = r.metric AND r.arm = 'hybrid' WHERE m.arm <> 'hybrid'),
s AS (SELECT split, arm, 'all' AS stratum, metric, x FROM x UNION ALL SELECT split, arm, lang, metric, x FROM x WHERE lang IS NOT NULL)
SELECT split, arm, stratum, metric, count(*) AS n, round(avg(x), 9) AS mean FROM s GROUP BY ALL"""


def ablation_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired bootstrap of each arm, stratum and metric: no SQL."""
    return reports.ablation_intervals(_ablation(spark, sf_dir), "hybrid", ["recall", "mrr"], "lang")


def ablation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arms as a Markdown table, one text."""
    arms = ablation_arms(spark, sf_dir)
    return reports.markdown_table(arms, {"split": F.col("split"), "arm": F.col("arm"), "n": F.col("n"), "rerank p95": reports.number_cell(F.col("rerank_ms_p95"))}, ["split", "arm"])


TABLE_SQL = f"""WITH {ABLATION}, t AS ({ARMS_SQL.split(ABLATION)[1].strip()})
SELECT '| split | arm | n | rerank p95 |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || split || ' | ' || arm || ' | ' || n || ' | ' || CASE WHEN rerank_ms_p95 IS NULL THEN 'n/a' ELSE printf('%.3f', rerank_ms_p95) END || ' |', chr(10) ORDER BY split, arm) AS text FROM t"""

def cut_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the arguments of a call, its long values cut."""
    rows = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.to_json(F.struct("doc_id", F.struct("text", "source").alias("inner"))).alias("json"))
    cut = rows.withColumn("cut", budgets.cut_values(F.col("json")))
    return cut.select("doc_id", F.get_json_object("cut", "$.inner.text").alias("text"), F.get_json_object("cut", "$.doc_id").alias("number"), F.get_json_object("cut", "$.inner.source").alias("source"))


CUT_SQL = """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '… (' || length(text) || ' chars)' ELSE text END AS text, doc_id::VARCHAR AS number,
CASE WHEN length(source) > 200 THEN substr(source, 1, 200) || '… (' || length(source) || ' chars)' ELSE source END AS source FROM documents WHERE text IS NOT NULL"""


def fitted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a tool's result within the budget: as many first turns as fit; ASCII only, as SQL doesn't escape others."""
    turns = read_table(spark, sf_dir, "conversations").where("NOT regexp_like(text, '[^ -~]')")
    lists = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.left(t["text"], F.lit(900))).alias("turns"))
    rows = lists.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct("turns", F.lit("end").alias("last")).alias("content"))).alias("json"))
    return budgets.fitted_outputs(rows, "json").where(F.col("fitted").contains('"shown"') | (F.char_length("json") <= 2000)).select("conv_id", "fitted")


FITTED_SQL = r"""WITH t AS (SELECT conv_id, turn, to_json(left(text, 900))::VARCHAR AS j FROM conversations WHERE NOT regexp_matches(text, '[^ -~]')), c AS (SELECT conv_id, list(j ORDER BY turn) AS js FROM t GROUP BY conv_id),
o AS (SELECT conv_id, len(js) AS n, '{"id": ' || conv_id || ', "content": {"turns": [' || array_to_string(js, ', ') || '], "last": "end"}}' AS whole, js FROM c),
g AS (SELECT conv_id, n, js, unnest(range(1, n)) AS k FROM o WHERE length(whole) > 2000),
p AS (SELECT conv_id, k, '{"id": ' || conv_id || ', "content": {"turns": [' || array_to_string(js[1:k], ', ') || '], "truncated": {"shown": ' || k || ', "of": ' || n || '}, "last": "end"}}' AS cut FROM g)
SELECT conv_id, whole AS fitted FROM o WHERE length(whole) <= 2000 UNION ALL SELECT conv_id, arg_max(cut, k) FROM p WHERE length(cut) <= 2000 GROUP BY conv_id"""

QUERIES = {
    f.__name__: f for f in (
        cut_arguments, fitted_results, source_listing, approval_rows, review_times, answer_findings, span_rows, span_review_scores, ablation_arms, ablation_mean_differences, ablation_intervals, ablation_table,
    )
}
ORACLES = {
    "cut_arguments": CUT_SQL, "fitted_results": FITTED_SQL, "source_listing": LISTING_SQL, "approval_rows": APPROVALS_SQL, "review_times": TIMES_SQL, "answer_findings": FINDINGS_SQL, "span_rows": SPANS_SQL, "span_review_scores": SCORES_SQL,
    "ablation_arms": ARMS_SQL, "ablation_mean_differences": DIFFERENCES_SQL, "ablation_table": TABLE_SQL,
}
