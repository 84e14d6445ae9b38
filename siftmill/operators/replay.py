"""Serving a run's recorded calls again, and where the second run leaves the first."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: agents whose recorded calls a replay never makes.
NOT_REPLAYED = ("memory",)


def replayed(recorded: DataFrame, calls: DataFrame, run: str = "run", order: str = "seq") -> DataFrame:
    """(run, agent, order, served, exact) of each call: the recorded call (its order) that serves it.

    Both tables have (run, order, agent, prompt). A call takes the first unused record of its agent and prompt,
    else the first unused one of its agent; with none left ``served`` is NULL: there the replay diverges.
    Exact and other calls compete for the same records, so those of a run and agent are matched in order, in
    one task, as a stream: a task holds the open records of one agent of one run, as hashes and numbers. NULL
    prompts are empty; repeated orders are served as ordered by prompt hash.
    """
    kinds = dict(calls.dtypes)

    def side(df: DataFrame, call: int) -> DataFrame:
        return df.select(F.col(run).alias("run"), "agent", F.lit(call).alias("call"), F.col(order).alias("seq"), F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("sha"))

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, by_sha, by_agent, used = None, {}, deque(), set()

        def first(queue: deque | None):
            while queue:
                record = queue.popleft()
                if record not in used:
                    used.add(record)
                    return record
            return None

        for batch in batches:
            out = []
            for at, agent, call, seq, sha in zip(*(batch[c].tolist() for c in ("run", "agent", "call", "seq", "sha"))):
                if (at, agent) != key:
                    key, by_sha, by_agent, used = (at, agent), {}, deque(), set()
                if not call:
                    record = (len(by_agent), seq)
                    by_sha.setdefault(sha, deque()).append(record)
                    by_agent.append(record)
                    continue
                found = first(by_sha.get(sha))
                exact = found is not None
                found = found or first(by_agent)
                out.append((at, agent, seq, found and found[1], exact))
            yield pd.DataFrame(out, columns=["run", "agent", "seq", "served", "exact"]).astype({"served": "object"})

    both = side(recorded, 0).union(side(calls, 1)).where("run IS NOT NULL AND agent IS NOT NULL")
    dealt = both.repartition("run", "agent").sortWithinPartitions("run", "agent", "call", "seq", "sha")
    schema = f"run {kinds[run]}, agent string, seq {kinds[order]}, served {kinds[order]}, exact boolean"
    return dealt.mapInPandas(serve, schema).withColumnsRenamed({"run": run, "seq": order})


def divergence(served: DataFrame, recorded: DataFrame, run: str = "run", order: str = "seq") -> DataFrame:
    """(run, n_calls, n_exact, diverged_at, unused_at, unused_agent): what became of each recorded run.

    ``diverged_at`` is the first call that no record was left for; ``unused_at`` the first record that no call
    took, of the agents that a replay calls. NULL where there is none.
    """
    told = served.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if("exact").alias("n_exact"), F.min(F.when(F.col("served").isNull(), F.col(order))).alias("diverged_at")
    )
    taken = served.where("served IS NOT NULL").select(run, "agent", F.col("served").alias(order))
    left = recorded.where(~F.col("agent").isin(*NOT_REPLAYED)).join(taken, [run, "agent", order], "left_anti")
    first = left.groupBy(run).agg(F.min_by(F.struct(F.col(order).alias("unused_at"), F.col("agent").alias("unused_agent")), F.struct(order, "agent")).alias("_first")).select(run, "_first.*")
    return recorded.select(run).distinct().join(told, run, "left").join(first, run, "left").select(
        run, F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"), "diverged_at", "unused_at", "unused_agent"
    )
