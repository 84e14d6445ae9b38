"""Events as tool calls of agent runs: their prices, admission, scores and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import agents as G
from siftmill.sources.tables import read_table

TOOLS = [("view", None, 5), ("click", ["u0", "u1"], 3), ("purchase", ["u2"], 2), ("signup", None, 1)]


def _pick(x, *names):
    return F.element_at(F.array(*map(F.lit, names)), (x % len(names) + 1).cast("int"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task"), F.concat(F.lit("u"), (e % 3).cast("string")).alias("specialist"), F.col("event_type").alias("tool"), (e % 7 > 0).alias("ok_args"), "event_id", "ts",
        _pick(e, "openai:gpt-4o-mini", "mock-gpt-4o", "replay:gpt-4o", "unknown-1").alias("model"), (e % 1000).alias("tokens_in"), (e % 333).alias("tokens_out"),
        _pick(e, "success", "failure", "rejected", "rate_limited").alias("status"), F.when(e % 4 < 2, (e % 5 / 4).cast("int")).alias("exit_code"),
        F.when(e % 4 < 2, (e * 37 % 3000).cast("int")).alias("result_chars"), "value", F.concat(F.lit("f"), (e % 5).cast("string")).alias("path"), e.cast("string").alias("content"),
    )


CALLS = """c AS (SELECT user_id AS task, 'u' || event_id % 3 AS specialist, event_type AS tool, event_id % 7 > 0 AS ok_args, event_id, ts, event_id % 4 AS m, event_id % 1000 AS tokens_in, event_id % 333 AS tokens_out,
  ['success', 'failure', 'rejected', 'rate_limited'][event_id % 4 + 1] AS status, CASE WHEN event_id % 4 < 2 THEN event_id % 5 // 4 END AS exit_code, CASE WHEN event_id % 4 < 2 THEN event_id * 37 % 3000 END AS result_chars, value, 'f' || event_id % 5 AS path FROM events),
u AS (SELECT *, CASE m WHEN 0 THEN round((tokens_in * 0.15::DOUBLE + tokens_out * 0.6::DOUBLE) / 1000000, 10) WHEN 1 THEN round((tokens_in * 2.5::DOUBLE + tokens_out * 10.0::DOUBLE) / 1000000, 10) ELSE 0.0 END AS usd FROM c)"""


def task_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.task_costs(G.with_cost(_calls(spark, sf_dir)), ["task", "tool"])
    return found.withColumn("usd", F.round("usd", 8))


COSTS_SQL = f"WITH {CALLS} SELECT task, tool, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(usd), 8) AS usd FROM u GROUP BY task, tool"


def admission_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(TOOLS, "tool string, owners array<string>, most int")
    return G.admissions(_calls(spark, sf_dir), tools, ["ts", "event_id"]).select("event_id", "should")


ADMISSION_SQL = f"""WITH {CALLS}, t(tool, owners, most) AS (VALUES ('view', NULL, 5), ('click', ['u0', 'u1'], 3), ('purchase', ['u2'], 2), ('signup', NULL, 1)),
o AS (SELECT c.*, most, t.tool IS NOT NULL AND (owners IS NULL OR list_contains(owners, specialist)) AS own FROM c LEFT JOIN t ON c.tool = t.tool),
n AS (SELECT *, count(*) FILTER (own) OVER (PARTITION BY task, tool ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS number FROM o)
SELECT event_id, CASE WHEN NOT own THEN 'rejected' WHEN number > most THEN 'rate_limited' WHEN NOT ok_args THEN 'failure' ELSE 'success' END AS should FROM n"""


def spending_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.with_cost(_calls(spark, sf_dir)).withColumn("worst", F.lit(0.004))
    return G.over_budget(rows, "task", ["ts", "event_id"], "usd", "worst", 0.02).select("event_id", F.round("spent_before", 9).alias("spent_before"))


SPENDING_SQL = f"""WITH {CALLS}, b AS (SELECT event_id, coalesce(sum(usd) OVER (PARTITION BY task ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u)
SELECT event_id, round(s, 9) AS spent_before FROM b WHERE s + 0.004::DOUBLE > 0.02::DOUBLE"""


def call_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.call_shares(_calls(spark, sf_dir), {"view": 1500})
    return found.withColumns({c: F.round(c, 9) for c in ("limited_share", "cut_share")})


SHARES_SQL = f"""WITH {CALLS} SELECT task, count(*) AS n, count(*) FILTER (status = 'failure' OR coalesce(exit_code, 0) <> 0) AS failed, count(*) FILTER (status = 'rate_limited') AS limited, round(count(*) FILTER (status = 'rate_limited') / count(*), 9) AS limited_share,
count(*) FILTER (m < 2 AND result_chars >= CASE tool WHEN 'view' THEN 1500 ELSE 2000 END) AS cut, round(count(*) FILTER (m < 2 AND result_chars >= CASE tool WHEN 'view' THEN 1500 ELSE 2000 END) / nullif(count(*) FILTER (m < 2), 0), 9) AS cut_share FROM c GROUP BY task"""


def must_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task must click or view with k 3, purchase with k 5, sign up, and view with k 4 and a key that no call has."""
    calls = _calls(spark, sf_dir).join(read_table(spark, sf_dir, "events").select("event_id", F.col("props").alias("arguments")), "event_id")
    tasks = calls.select("task").distinct()
    entries = [(1, ["click", "view"], '{"k": 3}'), (2, ["purchase"], '{"k": 5}'), (3, ["signup"], "{}"), (4, ["view"], '{"k": 4, "z": 9}')]
    must = tasks.crossJoin(F.broadcast(spark.createDataFrame(entries, "entry int, tools array<string>, arguments string")))
    return G.must_calls_met(must, calls)


MUST_SQL = """WITH c AS (SELECT user_id AS task, event_type AS tool, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 4 = 0), t AS (SELECT DISTINCT user_id AS task FROM events)
SELECT task, 1 AS entry, EXISTS (SELECT 1 FROM c WHERE c.task = t.task AND tool IN ('click', 'view') AND k = 3) AS met FROM t UNION ALL SELECT task, 2, EXISTS (SELECT 1 FROM c WHERE c.task = t.task AND tool = 'purchase' AND k = 5) FROM t UNION ALL SELECT task, 4, false FROM t
UNION ALL SELECT task, 3, EXISTS (SELECT 1 FROM c WHERE c.task = t.task AND tool = 'signup') FROM t"""


def files_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files f0 to f4 that no purchase of a task wrote, by two producers."""
    calls = _calls(spark, sf_dir)
    wrote = G.files_written(calls, "event_id", "purchase")
    need = calls.select("task").distinct().select("task", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    need = need.select("task", F.concat(F.lit("p"), (F.col("i") % 2).cast("string")).alias("producer"), F.concat(F.lit("f"), F.col("i").cast("string")).alias("path"))
    return G.missing_files(need, wrote).select("task", "producer", F.array_join("paths", ",").alias("paths"))


FILES_SQL = f"""WITH {CALLS}, n AS (SELECT DISTINCT task, i FROM c, range(0, 5) g(i)), w AS (SELECT DISTINCT task, path FROM c WHERE tool = 'purchase' AND m = 0)
SELECT n.task, 'p' || i % 2 AS producer, string_agg('f' || i, ',' ORDER BY i) AS paths FROM n LEFT JOIN w ON w.task = n.task AND w.path = 'f' || i WHERE w.path IS NULL GROUP BY n.task, i % 2"""


def last_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.files_written(_calls(spark, sf_dir), "event_id", "purchase")


WRITES_SQL = f"WITH {CALLS} SELECT task, path, max(event_id)::VARCHAR AS content FROM c WHERE tool = 'purchase' AND m = 0 GROUP BY task, path"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user under two labels with a verdict, NULL for some, and the parts and wholes of two shares."""
    own = _calls(spark, sf_dir).groupBy(F.col("task").alias("id")).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("tool") == "view").alias("views"), F.count_if(F.col("tool") == "click").alias("clicks"))
    both = own.withColumn("label", F.explode(F.array(F.lit("cross"), F.lit("same"))))
    x = F.col("id") + F.length("label")
    return both.withColumn("success", F.when(x % 5 > 0, x % 3 == 0)).withColumn("judge", _pick(x, "j1", "j2"))


TASKS = """o AS (SELECT user_id AS id, count(*) AS n_calls, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1),
t AS (SELECT *, id + length(label) AS x FROM o, (VALUES ('cross'), ('same')) l(label)), s AS (SELECT *, CASE WHEN x % 5 > 0 THEN x % 3 = 0 END AS success, ['j1', 'j2'][x % 2 + 1] AS judge FROM t)"""


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.label_scores(_tasks(spark, sf_dir), [("views", "n_calls"), ("clicks", "n_calls")])
    return found.select("label", "n", *[F.round(c, 9).alias(c) for c in found.columns[2:]])


LABELS_SQL = f"""WITH {TASKS} SELECT label, count(*) AS n, round(avg(views / n_calls), 9) AS views_mean, round(sum(views) / sum(n_calls), 9) AS views_pooled, round(avg(clicks / n_calls), 9) AS clicks_mean, round(sum(clicks) / sum(n_calls), 9) AS clicks_pooled FROM s GROUP BY label"""


def paired_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.paired_success(_tasks(spark, sf_dir), "cross", "same")


PAIRED_SQL = f"""WITH {TASKS}, p AS (SELECT a.success AS a, b.success AS b FROM s a JOIN s b USING (id) WHERE a.label = 'cross' AND b.label = 'same' AND a.success IS NOT NULL AND b.success IS NOT NULL)
SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM p"""


def run_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.run_headers(_tasks(spark, sf_dir))


HEADERS_SQL = f"WITH {TASKS} SELECT label, count(*) AS tasks, count(*) FILTER (success IS NULL) AS unjudged, string_agg(DISTINCT judge, ',' ORDER BY judge) AS judges FROM s GROUP BY label"


def compared_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every conversation against those of the one after it, as a fork of the same run."""
    turns = read_table(spark, sf_dir, "conversations")
    side = lambda run: turns.select(run.alias("run"), F.col("turn").alias("sid"), F.col("text").alias("output"))
    told = G.compared_outputs(side(F.col("conv_id")), side(F.col("conv_id") - 1), ["run"])
    return told.select("run", "sid", F.md5("original").alias("original"), F.md5("fork").alias("fork"))


COMPARED_SQL = """SELECT coalesce(a.conv_id, b.conv_id - 1) AS run, coalesce(a.turn, b.turn) AS sid, md5(a.text) AS original, md5(b.text) AS fork FROM conversations a FULL JOIN conversations b ON a.conv_id = b.conv_id - 1 AND a.turn = b.turn
WHERE a.text IS DISTINCT FROM b.text"""


def first_unused_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's recorded calls (tool and path as agent and prompt); the replay took those of events not divisible by 6."""
    rows = _calls(spark, sf_dir).select("task", F.col("event_id").alias("seq"), F.col("tool").alias("agent"), F.col("path").alias("prompt"))
    return G.first_unused(rows, rows.where("seq % 6 > 0"), "task", "seq")


UNUSED_SQL = f"""WITH {CALLS}, r AS (SELECT task, event_id, tool, path, row_number() OVER (PARTITION BY task, tool, path ORDER BY event_id) AS k FROM c),
n AS (SELECT task, tool, path, count(*) AS n FROM c WHERE event_id % 6 > 0 GROUP BY ALL), l AS (SELECT r.* FROM r LEFT JOIN n USING (task, tool, path) WHERE k > coalesce(n, 0))
SELECT task, min(event_id) AS seq, min_by(tool, event_id) AS agent FROM l GROUP BY task"""


def hosts_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", G.host_allowed(F.concat(F.lit("https://A"), (F.col("page_id") % 3).cast("string"), F.lit(".example.com:8080/x")), ["a1.example.com", "ple.com", "example.org"]).alias("allowed"))


HOSTS_SQL = "SELECT page_id, page_id % 3 = 1 AS allowed FROM pages"

QUERIES = {
    f.__name__: f for f in (
        task_costs, admission_audit, spending_audit, call_shares, must_calls, files_missing, last_writes, label_scores, paired_success, run_headers, compared_outputs,
        first_unused_call, hosts_allowed,
    )
}
ORACLES = {
    "task_costs": COSTS_SQL, "admission_audit": ADMISSION_SQL, "spending_audit": SPENDING_SQL, "call_shares": SHARES_SQL, "must_calls": MUST_SQL, "files_missing": FILES_SQL,
    "last_writes": WRITES_SQL, "label_scores": LABELS_SQL, "paired_success": PAIRED_SQL, "run_headers": HEADERS_SQL, "compared_outputs": COMPARED_SQL,
    "first_unused_call": UNUSED_SQL, "hosts_allowed": HOSTS_SQL,
}
