"""Questions put to people during agent runs, where a run goes after each answer, and the spans of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators.agents import CONFIDENCE, REVIEW

# How much a person decides by reason, and the prefix of a request's attributes.
LEVELS = {
    "low_plan_confidence": "approve_plan", "user_requested": "approve_plan", "sensitive_operation": "approve_action",
    "specialist_double_failure": "approve_action", "low_review_score": "approve_action",
}
ATTRIBUTE_PREFIX = "rag."


def level(trigger: Column, overrides: dict[str, str] | None = None) -> Column:
    """The level of a trigger, that of ``overrides`` first; NULL for an unknown one."""
    table = LEVELS | (overrides or {})
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), trigger)


def opened(approvals: DataFrame, requests: DataFrame) -> DataFrame:
    """``approvals`` with a row for each (task, gate) of ``requests`` that has none yet: its earliest request.

    Requests are (approval_id, task, gate, trigger, level, created_at), approvals have status, action and
    resolved_at (timestamps) and review_seconds besides. One of level notify is told and done at once, any
    other waits. Requests without task or gate are left out.
    """
    own = ["approval_id", "trigger", "level", "created_at"]
    first = requests.where("task IS NOT NULL AND gate IS NOT NULL").groupBy("task", "gate").agg(F.min_by(F.struct(*own), F.struct("created_at", "approval_id")).alias("_first"))
    fresh = first.join(approvals.select("task", "gate"), ["task", "gate"], "left_anti").select("task", "gate", "_first.*")
    told = F.col("level").eqNullSafe("notify")
    fresh = fresh.withColumn("status", F.when(told, "notified").otherwise("pending")).withColumn("resolved_at", F.when(told, F.col("created_at")))
    return approvals.unionByName(fresh.withColumn("action", F.lit(None).cast("string")).withColumn("review_seconds", F.lit(None).cast("double")))


def resolved(approvals: DataFrame, answers: DataFrame) -> DataFrame:
    """``approvals`` after the first answer (approval_id, action, at) to each pending one; the others stay as they are."""
    first = answers.groupBy("approval_id").agg(F.min_by(F.struct("action", "at"), F.struct("at", "action")).alias("_answer"))
    joined = approvals.join(first, "approval_id", "left")
    now = (F.col("status") == "pending") & F.col("_answer").isNotNull()
    seconds = (F.unix_micros("_answer.at") - F.unix_micros("created_at")) / 1e6
    new = {"status": F.lit("resolved"), "action": F.col("_answer.action"), "resolved_at": F.col("_answer.at"), "review_seconds": seconds}
    return joined.select(*[F.when(now, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in approvals.columns])


def answer_findings(approvals: DataFrame, answers: DataFrame) -> DataFrame:
    """(approval_id, finding) of answers (approval_id, action, payload) that must not be taken.

    ``payload`` maps names to texts. Taking over a plan or the end needs final_output, a subtask output;
    modifying needs plan, final_output or arguments by its gate.
    """
    asked = answers.join(approvals.select("approval_id", "gate", "status"), "approval_id", "left")
    gate, action = F.col("gate"), F.col("action")
    needs = (
        F.when((action == "take_over") & gate.isin("plan", "final"), "final_output").when((action == "take_over") & gate.startswith("subtask:"), "output")
        .when((action == "modify") & (gate == "plan"), "plan").when((action == "modify") & (gate == "final"), "final_output")
        .when((action == "modify") & gate.startswith("tool:"), "arguments")
    )
    given = F.coalesce(F.try_element_at("payload", needs), F.lit("")) != ""
    finding = (
        F.when(F.col("status").isNull(), "unknown approval").when(F.col("status") != "pending", F.concat(F.lit("is "), "status"))
        .when(needs.isNotNull() & ~given, F.concat(action, F.lit(" needs "), needs))
    )
    return asked.select("approval_id", finding.alias("finding")).where("finding IS NOT NULL")


def review_listing(approvals: DataFrame, status: str | None = None, task: str | None = None) -> DataFrame:
    """Approvals of a status and a task, the newest first."""
    for name, value in (("status", status), ("task", task)):
        approvals = approvals if value is None else approvals.where(F.col(name) == value)
    return approvals.orderBy(F.desc("created_at"), "approval_id")


def review_times(approvals: DataFrame) -> DataFrame:
    """(trigger, level, n, pending, mean_seconds) of all approvals."""
    return approvals.groupBy("trigger", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("pending"), F.avg("review_seconds").alias("mean_seconds"))


def after_plan(has_plan: Column, confidence: Column, requested: Column, threshold: float = CONFIDENCE) -> Column:
    """Where a run goes with its plan: failed, escalate_plan or schedule; an unknown confidence is full."""
    unsure = F.coalesce(requested, F.lit(False)) | (F.coalesce(confidence, F.lit(1.0)) < threshold)
    return F.when(~F.coalesce(has_plan, F.lit(False)), "failed").when(unsure, "escalate_plan").otherwise("schedule")


def after_answer(gate: Column, action: Column) -> Column:
    """Where a run goes after a person's answer at a gate (plan, subtask:..., final); no answer is an approval."""
    said = F.coalesce(action, F.lit("approve"))
    ends = (said == "reject") | ((said == "fail") & (gate != "final"))
    return F.when(ends, "end").when((gate == "final") | ((gate == "plan") & (said == "take_over")), "deliver").otherwise("schedule")


def span_rows(spans: DataFrame) -> DataFrame:
    """Spans of tasks with task_id, kind, agent and status as columns instead of attributes.

    ``spans`` (span_id, parent_id, trace_id, name, error, attributes, start_time, end_time) has a map of
    texts; kind is node by default, status failure where the span has an error, else success. Spans without
    a task are left out. duration_ms is a double.
    """
    own = lambda name: F.try_element_at("attributes", F.lit(f"orchestrator.{name}"))
    status = F.when(F.coalesce(own("status"), F.lit("")) != "", own("status")).when(F.col("error"), "failure").otherwise("success")
    popped = [f"orchestrator.{name}" for name in ("status", "task_id", "kind", "agent")]
    told = spans.withColumn("task_id", own("task_id")).where("task_id <> ''")
    return told.select(
        "span_id", "trace_id", "parent_id", "task_id", "name", F.coalesce(own("kind"), F.lit("node")).alias("kind"), own("agent").alias("agent"), status.alias("status"),
        F.map_filter("attributes", lambda k, _: ~k.isin(popped)).alias("attributes"), "start_time", "end_time",
        ((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e3).alias("duration_ms"),
    )


def request_attributes(values: Column, timings: Column, prefix: str = ATTRIBUTE_PREFIX) -> Column:
    """A map of the values that aren't NULL, and of each stage's time, under prefixed names."""
    shown = F.transform_keys(F.map_filter(values, lambda _, v: v.isNotNull()), lambda k, _: F.concat(F.lit(prefix), k))
    stages = F.transform_keys(timings, lambda k, _: F.concat(F.lit(f"{prefix}timings_ms."), k))
    none = F.create_map().cast("map<string,string>")
    return F.map_concat(F.coalesce(shown.cast("map<string,string>"), none), F.coalesce(stages.cast("map<string,string>"), none))


def scheduled_waves(spans: DataFrame) -> DataFrame:
    """(task_id, waves): the lists of subtasks of a task's ``schedule`` spans, in order of start; empty or broken ones left out."""
    wave = F.from_json(F.try_element_at("attributes", F.lit("wave")), "array<string>")
    own = spans.where("name = 'schedule'").select("task_id", "start_time", "span_id", wave.alias("wave")).where("size(wave) > 0")
    ordered = F.array_sort(F.collect_list(F.struct("start_time", "span_id", "wave")))
    return own.groupBy("task_id").agg(F.transform(ordered, lambda s: s["wave"]).alias("waves"))


def review_scores(spans: DataFrame) -> DataFrame:
    """(task_id, sid, scores, rejected): a subtask's review scores in order of start, and the feedback of those too low.

    A score of 0 or none counts as given in scores, but not as too low.
    """
    at = lambda name: F.try_element_at("attributes", F.lit(name))
    own = spans.where("kind = 'review'").select("task_id", "start_time", "span_id", at("sid").alias("sid"), at("score").try_cast("int").alias("score"), at("feedback").alias("feedback"))
    ordered = F.array_sort(F.collect_list(F.struct("start_time", "span_id", "score", "feedback")))
    return own.groupBy("task_id", "sid").agg(ordered.alias("_r")).select(
        "task_id", "sid", F.transform("_r", lambda r: r["score"]).alias("scores"),
        F.transform(F.filter("_r", lambda r: r["score"].between(1, REVIEW - 1)), lambda r: r["feedback"]).alias("rejected"),
    )
