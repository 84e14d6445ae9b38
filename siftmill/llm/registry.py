"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftmill.llm import automaton_dedup, ball_simhash, bradley_terry, hyperdim_lang, license_zstd, lsm_dedup, page_differencing, periodic_runs, pii_crf, pivot_index, prefix_trie, slack_packing, systematic_mix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = (
        bradley_terry.op1_bradley_terry,
        slack_packing.op2_slack_packing,
        pii_crf.op3_pii_crf,
        lsm_dedup.op4_exact_dedup,
        systematic_mix.op5_systematic_mix,
        pivot_index.op6_pivot_index,
        automaton_dedup.op7_automaton_dedup,
        license_zstd.op8_license_zstd,
        hyperdim_lang.op9_hyperdim_lang,
        ball_simhash.op10_ball_simhash,
        periodic_runs.op11_periodic_runs,
        page_differencing.op12_page_differencing,
        prefix_trie.op13_prefix_trie,
    )
    return {f.__name__: f for f in functions}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": lsm_dedup.ORACLE,
        "op5_systematic_mix": systematic_mix.ORACLE,
        "op6_pivot_index": pivot_index.ORACLE,
        "op7_automaton_dedup": automaton_dedup.ORACLE,
        "op11_periodic_runs": periodic_runs.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
