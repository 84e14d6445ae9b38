"""Keyed state dealt in files, with late rows and a restart, against plain loops; the sink after a failed batch."""

import random

import pytest
from pyspark.sql import functions as F

from siftmill.sources.tables import new_path
from siftmill.streaming import sinks, state

SCHEMA = "event_id long, ts timestamp, task string, field string, tool string, status string, cost double"
HOUR = 3600


def made(seed=0, n=240):
    rng, rows, t = random.Random(seed), [], 1_700_000_000.0
    for i in range(n):
        t += rng.choice((1, 60, 600, 3000))
        rows.append((i, t, rng.choice("abc"), rng.choice((None, "plan", "x", "y")), rng.choice(("web", "file")), rng.choice(("success", "failure", "rejected")), round(rng.random(), 3)))
    return rows


def stream(spark, rows, folder, parts, late):
    """A file stream: rows in files in order, but for those of a file's last hour, which come a file later."""
    files = [rows[i::1][: len(rows) // parts + 1] for i in range(0, len(rows), len(rows) // parts + 1)]
    for f in range(len(files) - 1):
        end = max(r[1] for r in files[f])
        moved = [r for r in files[f] if end - HOUR < r[1] < end] if late else []
        files[f] = [r for r in files[f] if r not in moved]
        files[f + 1] = files[f + 1] + moved
    for f, part in enumerate(files):
        df = spark.createDataFrame([(r[0], None, *r[2:], r[1]) for r in part], "event_id long, ts timestamp, task string, field string, tool string, status string, cost double, s double")
        df.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(folder)
        yield spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, build, rows, parts=4, late=True):
    """Starts anew from the same checkpoint after each file."""
    folder, out, check = (new_path(spark, x) for x in ("in", "out", "check"))
    for source in stream(spark, rows, folder, parts, late):
        told = build(source)
        told.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(told.schema).parquet(out)


def passed(rows):
    end = max(r[1] for r in rows) - HOUR
    return [r for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[1] < end]


def test_working_memory(spark):
    rows = made()
    got = {r.event_id: (r.started, r.n_fields, r.n_errors) for r in run(spark, lambda s: state.working_memory(s, 3 * HOUR), rows).collect()}
    want, lives = {}, {}
    for i, t, task, field, *_ in passed(rows):
        start, last, fields, errors = lives.get(task, (t, t, set(), 0))
        if t - last >= 3 * HOUR:
            start, fields, errors = t, set(), 0
        fields, errors = fields | ({field} if field else set()), errors + (field is None)
        lives[task] = (start, t, fields, errors)
        want[i] = (int(start * 1e6), len(fields), errors)
    assert got == want and len({w[0] for w in want.values()}) > 3


def test_ceilings_and_limits(spark):
    rows = made(1)
    calls, cost, limits, want, wanted = {}, {}, {}, {}, {}
    for i, _, task, _, tool, status, c in passed(rows):
        n, spent = calls.get(task, 0), cost.get(task, 0.0)
        want[i] = (n, round(spent, 6), n < 30 and spent < 12.5)
        if want[i][2]:
            calls[task], cost[task] = n + 1, spent + c
        k = limits.get((task, tool), 0)
        wanted[i] = (k, k < 20)
        limits[task, tool] = k + (k < 20 and status != "rejected")
    got = run(spark, lambda s: state.ceilings(s, 30, 12.5), rows)
    assert {r.event_id: (r.calls_before, round(r.cost_before, 6), r.admitted) for r in got.collect()} == want
    got = run(spark, lambda s: state.rate_limits(s, 20), rows, parts=2)
    assert {r.event_id: (r.executed_before, r.admitted) for r in got.collect()} == wanted


def test_snapshot(spark):
    rows = [("a", "f", 1.0, 0), ("a", "f", 2.0, 10), ("a", None, 3.0, 15), ("a", None, 4.0, 15), ("b", "g", 5.0, 0), ("b", "h", 6.0, 30), ("a", "f", 9.0, 99), (None, "f", 7.0, 1), ("c", "f", 7.0, None)]
    writes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, task string, field string, value double, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(state.memory_snapshot(writes, 35_000_000, 25).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([("a", "f", 2.0, None), ("a", None, 3.0, 1), ("a", None, 4.0, 2), ("b", "h", 6.0, None)], key=str)


def test_a_batch_run_twice_is_written_once(spark):
    folder, out, check = (new_path(spark, x) for x in ("in", "out", "check"))
    spark.range(100).withColumnRenamed("id", "prompt_tokens").repartition(4).write.parquet(folder)
    source = lambda: spark.readStream.schema("prompt_tokens long").option("maxFilesPerTrigger", 1).parquet(folder)

    def fails(number):
        if number == 2:
            raise OSError("after the write")

    with pytest.raises(Exception, match="after the write"):
        sinks.idempotent_append(source(), out, check, sinks.trace_rows, fails)
    held = sinks.appended(spark, out, "mode string, prompt_tokens long").count()
    assert 0 < held < 100
    sinks.idempotent_append(source(), out, check, sinks.trace_rows)
    sinks.idempotent_append(source(), out, check, sinks.trace_rows)
    kept = sinks.appended(spark, out, "mode string, prompt_tokens long, refused boolean")
    assert sorted(r.prompt_tokens for r in kept.collect()) == list(range(100)) and kept.where("mode = 'dense' AND NOT refused").count() == 100


def test_a_ceiling_of_cost_is_reached_exactly(spark):
    rows = [(i, 1_700_000_000.0 + 60 * i, "a", None, "web", "success", 0.1) for i in range(14)] + [(14, 1_700_100_000.0, "b", None, "web", "success", None)]
    got = run(spark, lambda s: state.ceilings(s, 0, 1.0), rows, 2, False).where("NOT admitted").collect()
    assert {(r.event_id, r.calls_before, r.cost_before) for r in got} == {(i, 10, 1.0) for i in range(10, 14)}
