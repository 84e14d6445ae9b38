"""Keyed state over event streams, in order of event time: working memory with a time to live, ceilings, limits.

Rows of a key wait in its state until the watermark has passed them, so that late rows within the delay take
their place; then each is decided in order of (time, number). What a key knows is dropped when its time to
live has run out. State is kept by Spark's state store under the query's checkpoint: a run that stops goes on
where its last committed batch ended, wherever the next one runs. Rows later than the watermark are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Context, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftmill.streaming.events import DELAY

#: Fixed value: seconds that a task's working memory lives after its last write.
TTL_SECONDS = 86_400
#: Costs are added with fifty digits; what isn't finite makes no error.
EXACT = Context(prec=50, traps=[])


def in_order(events: DataFrame, key: str, fields: list[str], result: str, step: Callable[[dict, dict], tuple], ttl_seconds: int | None = None, time: str = "ts", number: str = "event_id", delay: str = DELAY) -> DataFrame:
    """(key, number, result fields): what ``step`` gives for each row of a key, in order of (time, number).

    ``step`` gets what the key knows (a dictionary that JSON can hold, empty at first, which it changes) and
    the row's fields, and returns a tuple of the result's fields. With ``ttl_seconds`` a row that comes so long
    after the one before it, or later, meets an empty dictionary. Rows without a key or a time are left out.
    """
    own = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    own = own.select(F.col(key).alias("key"), F.col(time), F.unix_micros(time).alias("at"), F.col(number).alias("number"), *fields)
    kinds = dict(own.dtypes)
    names = ["key", "number", *(f.split()[0] for f in result.split(", "))]
    ttl = ttl_seconds and ttl_seconds * 1_000_000

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last, waiting = json.loads(state.get[0]) if state.exists else ({}, None, [])
        for part in parts:
            columns = [[None if pd.isna(v) else v for v in part[c].tolist()] for c in ("at", "number", *fields)]
            waiting += map(list, zip(*columns))
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: (r[0], r[1]))
        out = []
        while waiting and waiting[0][0] < passed:
            at, number, *values = waiting.pop(0)
            if ttl and last is not None and at - last >= ttl:
                known = {}
            out.append((key[0], number, *step(known, {"at": at} | dict(zip(fields, values)))))
            last = at
        if not waiting and (last is None or (ttl and last + ttl < passed)):
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps((known, last, waiting)),))
            wake = waiting[0][0] if waiting else last + ttl if ttl else None
            if wake is not None:
                state.setTimeoutTimestamp(max(wake // 1000, passed // 1000))
        if out:
            yield pd.DataFrame(out, columns=names)

    schema = f"key {kinds['key']}, number {kinds['number']}, {result}"
    done = own.groupBy("key").applyInPandasWithState(fold, schema, "known string", "append", GroupStateTimeout.EventTimeTimeout)
    return done.withColumnsRenamed({"key": key, "number": number})


def working_memory(writes: DataFrame, ttl_seconds: int = TTL_SECONDS, task: str = "task", field: str = "field", time: str = "ts", number: str = "event_id", delay: str = DELAY) -> DataFrame:
    """(task, number, started, n_fields, n_errors) after each write of a stream of working-memory writes.

    A write sets its field, or adds an error where the field is NULL, and extends the life of all the task's
    rows; a task whose last write is a time to live or longer ago starts empty. ``started`` is the first write
    of the life (microseconds). What is kept of a task is the names of its fields and a count.
    """

    def write(known: dict, row: dict) -> tuple:
        known.setdefault("started", row["at"])
        if row[field] is None:
            known["errors"] = known.get("errors", 0) + 1
        else:
            known.setdefault("fields", {})[row[field]] = 1
        return known["started"], len(known.get("fields", {})), known.get("errors", 0)

    return in_order(writes, task, [field], "started long, n_fields long, n_errors long", write, ttl_seconds, time, number, delay)


def memory_lives(writes: DataFrame, ttl_seconds: int = TTL_SECONDS, task: str = "task", time: str = "ts", number: str = "event_id") -> DataFrame:
    """The batch twin's rows: ``writes`` with ``started``, the first write of the life that each belongs to (microseconds)."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    ordered = Window.partitionBy(task).orderBy(time, number)
    new = F.coalesce(at - F.lag(at).over(ordered) >= ttl_seconds * 1_000_000, F.lit(True))
    return writes.where(F.col(task).isNotNull() & F.col(time).isNotNull()).withColumn("started", F.max(F.when(new, at)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))


def memory_snapshot(writes: DataFrame, now_micros: int, ttl_seconds: int = TTL_SECONDS, task: str = "task", field: str = "field", value: str = "value", time: str = "ts", number: str = "event_id") -> DataFrame:
    """(task, field, value, place) of the tasks alive at ``now_micros``: the last value of each field of the life, and
    its errors (NULL field) with their place in order. Later writes don't count."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    lives = memory_lives(writes.where(at <= now_micros), ttl_seconds, task, time, number)
    newest = lives.groupBy(task).agg(F.max("started").alias("_life"), F.max(at).alias("_last")).where(F.col("_last") + ttl_seconds * 1_000_000 > now_micros)
    live = lives.join(newest.withColumnRenamed(task, "_task"), (F.col(task) == F.col("_task")) & (F.col("started") == F.col("_life")))
    order = F.struct(F.col(time), F.col(number))
    fields = live.where(F.col(field).isNotNull()).groupBy(task, field).agg(F.max_by(value, order).alias(value)).withColumn("place", F.lit(None).cast("int"))
    place = F.row_number().over(Window.partitionBy(task).orderBy(time, number))
    return fields.unionByName(live.where(F.col(field).isNull()).select(task, field, value, place.alias("place")))


def ceilings(calls: DataFrame, max_calls: int, max_cost: float, task: str = "task", cost: str = "cost", time: str = "ts", number: str = "event_id", delay: str = DELAY) -> DataFrame:
    """(task, number, calls_before, cost_before, admitted) of each call of a stream, in order; 0 lifts a ceiling.

    A call is refused once the admitted calls, or their cost, have reached a ceiling; refused calls don't count.
    Costs are added as decimals, so ten calls at 0.1 have reached 1.
    """

    def admit(known: dict, row: dict) -> tuple:
        n, exact = known.get("calls", 0), Decimal(str(known.get("cost", 0)))
        spent = float(exact)
        refused = (max_calls and n >= max_calls) or (max_cost and spent >= max_cost)
        if not refused:
            known["calls"], known["cost"] = n + 1, str(EXACT.add(exact, Decimal(str(row[cost] or 0))))
        return n, spent, not refused

    return in_order(calls, task, [cost], "calls_before long, cost_before double, admitted boolean", admit, None, time, number, delay)


def rate_limits(calls: DataFrame, limit: int, task: str = "task", tool: str = "tool", status: str = "status", executed: tuple[str, ...] = ("success", "failure"), time: str = "ts", number: str = "event_id", delay: str = DELAY) -> DataFrame:
    """(task, number, tool, executed_before, admitted) of each call of a stream, in order.

    A call is over the limit once so many calls of its task and tool were executed; of those admitted, the ones
    whose status says that they were executed count.
    """

    def admit(known: dict, row: dict) -> tuple:
        n = known.get(str(row[tool]), 0)
        if n < limit and row[status] in executed:
            known[str(row[tool])] = n + 1
        return row[tool], n, n < limit

    return in_order(calls, task, [tool, status], "tool string, executed_before long, admitted boolean", admit, None, time, number, delay)
