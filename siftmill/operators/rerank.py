"""Reranking: the text of fused hits, scores of (query, text) pairs by a scorer loaded once a worker, the best of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.operators.ranking import DENSE_WEIGHT, RRF_K, SPARSE_WEIGHT

# Hits of each leg and of the fusion that are reranked, and how many are given.
CANDIDATES, TOP = 20, 5


class PairScorer(Protocol):
    """A scorer of one query's texts: a number each, higher is better, of any range."""

    def score_pairs(self, query: str, texts: Sequence[str]) -> Sequence[float]: ...


def resolved(dense: DataFrame, sparse: DataFrame, by: list[str]) -> DataFrame:
    """(by..., id, dense_rank, sparse_rank, text) of the hits of either leg (by..., id, rank, text); the dense text wins."""
    a = dense.select(*by, "id", F.col("rank").alias("dense_rank"), F.col("text").alias("_dense"), F.lit(True).alias("_in"))
    b = sparse.select(*by, "id", F.col("rank").alias("sparse_rank"), F.col("text").alias("_sparse"))
    text = F.when(F.coalesce("_in", F.lit(False)), F.col("_dense")).otherwise(F.col("_sparse"))
    return a.join(b, [*by, "id"], "full").select(*by, "id", "dense_rank", "sparse_rank", text.alias("text"))


def fused(hits: DataFrame, by: list[str], weights: tuple[float, float] = (DENSE_WEIGHT, SPARSE_WEIGHT), k: int = RRF_K, top: int = CANDIDATES) -> DataFrame:
    """The ``top`` of each query's resolved hits by weighted reciprocal rank (score desc, id)."""
    part = lambda w, rank: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    scored = hits.withColumn("fused", part(weights[0], "dense_rank") + part(weights[1], "sparse_rank"))
    return scored.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("fused"), "id"))).where(F.col("_place") <= top).drop("_place")


def pair_scores(load: Callable[[], PairScorer]):
    """A column function of (query, text): the scorer's number of each pair, NULL texts as empty ones.

    ``load`` is sent to the workers and called once in each that gets rows, not once a batch; the pairs of a
    batch that have the same query are scored in one call.
    """
    key = id(load)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = _loaded.get(key) or _loaded.setdefault(key, load())
        for queries, texts in batches:
            out = pd.Series(0.0, index=queries.index)
            for query, at in queries.fillna("").groupby(queries.fillna("")).groups.items():
                out[at] = [float(s) for s in scorer.score_pairs(query, texts[at].fillna("").tolist())]
            yield out

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


_loaded: dict[int, PairScorer] = {}


def reranked(candidates: DataFrame, by: list[str], query: str, load: Callable[[], PairScorer], top: int = TOP) -> DataFrame:
    """(by..., id, text, score, place): the best of each query's candidates by (score desc, id); the score is the sigmoid of the scorer's.

    A query has few candidates (CANDIDATES), so its window is short.
    """
    raw = pair_scores(load)(F.col(query), F.col("text"))
    scored = candidates.withColumn("_raw", raw).withColumn("score", 1 / (1 + F.exp(-F.col("_raw"))))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select(*by, "id", "text", "score", "place")


class OverlapScorer:
    """A linear scorer without a model: the query's different words that a text has, less the text's length in thousands of characters."""

    def score_pairs(self, query: str, texts: Sequence[str]) -> Sequence[float]:
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) - len(t) / 1000 for t in texts]
