"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of its features. The weights are learned from preference pairs, a
better document against a worse one: the logistic loss of the difference of their strengths, which only
needs the difference of their features. The threshold is the quantile of the learning rows' strengths at
the share of worse documents, and strengths are mapped to 0..1 so that the threshold falls on a given score.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.storage import documents

#: At most about this many labelled rows are learned from; they are picked by a hash of the identifier.
SAMPLE_ROWS = 20_000
#: Preference pairs drawn from the sample.
PAIRS = 60_000
THRESHOLD_SCORE = 0.3
_SCALE = 1_000_000

_LETTERS = re.compile(r"[^\W\d_]")
FEATURES = (
    "log words", "mean word length", "upper share", "digit share", "white share", "line share", "full stops",
    "commas", "exclamation marks", "bars", "other marks", "non-ASCII share", "repeated neighbours",
    "distinct words", "distinct lines", "marked words", "shouted words", "capital starts", "distinct in parts",
)


def _classes() -> np.ndarray:
    """Byte to class: upper, lower, digit, white, newline, '.', ',', '!', '|', other mark, non-ASCII."""
    table = np.full(256, 9)
    table[128:] = 10
    for cls, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"|")):
        table[list(chars)] = cls
    return table


_CLASS = _classes()
_MARKS = tuple(bytes([c]) * n for c in b"!#$%&*" for n in (2, 3))


def features(text: str | None) -> np.ndarray:
    """The features of one whole text; zeros for an empty one."""
    out = np.zeros(len(FEATURES), np.float64)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out
    n, size = len(words), len(raw)
    by_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=11)
    letters = max(1.0, by_class[0] + by_class[1] + by_class[10])
    lines = raw.split(b"\n")
    out[0] = math.log1p(n)
    out[1] = min(30.0, (size - by_class[3] - by_class[4]) / n)
    out[2] = by_class[0] / letters
    out[3] = by_class[2] / size
    out[4] = by_class[3] / size
    out[5] = by_class[4] / n
    out[6] = by_class[5] / n
    out[7] = by_class[6] / n
    out[8] = by_class[7] / n
    out[9] = by_class[8] / n
    out[10] = by_class[9] / n
    out[11] = by_class[10] / size
    out[12] = sum(map(operator.eq, words, words[1:])) / n
    out[13] = len(set(words)) / n
    out[14] = len(set(lines)) / len(lines)
    out[15] = sum(w.endswith(_MARKS) for w in words) / n
    out[16] = sum(map(bytes.isupper, words)) / n
    out[17] = sum(map(bytes.istitle, words)) / n
    part = 64
    out[18] = sum(len(set(words[i : i + part])) for i in range(0, n, part)) / n
    return out


@dataclass(frozen=True)
class Ranking:
    """Learned weights; ``score`` maps a strength to 0..1 with the threshold at THRESHOLD_SCORE."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.threshold) / self.width + math.log(THRESHOLD_SCORE / (1 - THRESHOLD_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def column(self):
        """A column function: text to score."""

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
                yield pd.Series(self.score(x))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, T.DoubleType())


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, rounds: int = 400, seed: int = 5) -> Ranking:
    """Weights from preference pairs between rows with label 1 and rows with label 0.

    With one label only there are no pairs: all weights are 0 and every text scores THRESHOLD_SCORE.
    """
    mean = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    spread = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(len(FEATURES))
    z = np.clip((x - mean) / spread, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(len(FEATURES))
    if not len(good) or not len(bad):
        return Ranking(mean, spread, weights, 0.0, 1.0)
    rng = np.random.default_rng(seed)
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    momentum, rate = np.zeros_like(weights), 0.5
    for _ in range(rounds):
        beaten = 1 / (1 + np.exp(np.clip(difference @ weights, -40, 40)))  # chance that the worse one wins
        gradient = l2 * weights - difference.T @ beaten / pairs
        momentum = 0.9 * momentum - rate * gradient
        weights = weights + momentum
    strengths = z @ weights
    threshold = float(np.quantile(strengths, len(bad) / len(y)))
    width = float(np.median(np.abs(strengths - threshold))) / 2 or 1.0
    return Ranking(mean, spread, weights, threshold, width)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Ranking:
    """A ranking from the labelled rows of ``docs``.

    About ``sample_rows`` labels are used, whatever their number: rows with a NULL label or identifier, or
    without a document, teach nothing; of an identifier with several labels the least counts. Features are
    taken on the executors and the driver gets at most some ``sample_rows`` x 20 numbers.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    own = own.groupBy("id").agg(F.min("label").alias("label"))
    total = own.count()
    picked = own.where(F.pmod(F.xxhash64("id"), F.lit(_SCALE)) < F.lit(_SCALE * sample_rows / max(total, 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "x": [features(t).tolist() for t in batch["text"]]})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    sample = texts.join(F.broadcast(picked), "id").select("id", "label", "text")  # ``picked`` is bounded by sample_rows
    rows = sorted((r["id"], r["label"], r["x"]) for r in sample.mapInPandas(run, f"id {kind}, label int, x array<double>").collect())
    return fit(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows]))


def score_quality(docs: DataFrame, ranking: Ranking, text_col: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text: no join, no shuffle.

    NULL and empty texts have the score of all-zero features. Repeated rows score alike; an empty table
    stays empty. A column of the name ``output`` is replaced,
    so give a name that ``docs`` doesn't have to keep it.
    """
    return docs.withColumn(output, ranking.column()(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op1_bradley_terry(spark, sf_dir: str) -> DataFrame:
    """The score of each document; held_out is NULL where doc_id is."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score_quality(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD_SCORE).cast("int").alias("predicted"))
