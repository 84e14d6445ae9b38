"""The registry of named queries and their DuckDB SQL.

Each module of :mod:`siftmill.plans` that holds queries has ``QUERIES`` (name to callable of session and
dataset folder) and ``ORACLES`` (name to SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftmill.plans import (
    agent_queries, answer_queries, corpus_queries, golden_queries, index_queries,
    evaluation_queries, log_queries, memory_queries, ranking_queries, record_queries, rendering_queries, report_queries, retrieval_queries, run_queries, sql_queries, state_queries, stream_queries, structure_queries, text_queries,
)

MODULES = (index_queries, record_queries, run_queries, state_queries, report_queries, answer_queries, agent_queries, golden_queries, corpus_queries, retrieval_queries, text_queries, ranking_queries, evaluation_queries, log_queries, structure_queries, rendering_queries, memory_queries, sql_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
