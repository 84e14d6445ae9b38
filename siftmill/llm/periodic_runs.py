"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Every block of 2^k consecutive words of a text gets a name; equal blocks of one text have equal names. A
block of twice the length is named by the pair of its halves' names, and a block that its text has once
needs no name, so few levels and few positions are left of prose. Where two positions agree, the common
extension to either side is read off the names from the longest level down, for all pairs of many texts at
once. A run of period p and at least 2p words holds two neighbouring points of the grid 0, p, 2p, ..., so
these pairs are all the candidates: each is extended both ways and kept where it is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.storage import WORD_PATTERN, documents

LEAST_LENGTH = 12
#: Words named together (a longer text is named alone), and grid pairs extended together.
BLOCK_WORDS, BLOCK_PAIRS = 1 << 16, 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def first_names(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word of the texts, one after another; equal for equal words of one text only."""
    out, base = [], 0
    for words in texts:
        names: dict[bytes, int] = {}
        out += [base + names.setdefault(w, len(names)) for w in words]
        base += len(names)
    return np.array(out, np.int64)


def _repeated(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of n + 1 positions: the rank of the key where it occurs again, else a number of the position's own."""
    names = -1 - np.arange(n + 1)
    _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[rank] > 1
    names[at[again]] = rank[again]
    return names


def power_names(words: np.ndarray) -> list[np.ndarray]:
    """Level k has the names of the blocks of 2^k words by their start; levels end where no block is repeated."""
    n, levels = len(words), []
    names = _repeated(words, np.arange(n), n)
    while (at := np.flatnonzero(names >= 0)).size:
        levels.append(names)
        size = 1 << (len(levels) - 1)
        at = at[at + size <= n]
        at = at[names[at + size] >= 0]
        names = _repeated(names[at] * (n + 1) + names[at + size], at, n)
    return levels


def _ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal words from i and from j on."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same += (levels[k][i + same] == levels[k][j + same]).astype(np.int64) << k
    return same


def _behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal words before i and before j."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - same - (1 << k), j - same - (1 << k)
        within = a >= 0
        same += (within & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])).astype(np.int64) << k
    return same


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period): the grid points of every period of every text that have a next one, in pieces."""
    halves = sizes // 2
    text = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    points = (sizes[text] - 1) // period if len(text) else period
    ends = np.cumsum(points)
    a = 0
    while a < len(text):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + BLOCK_PAIRS, side="right")))
        own = points[a:b]
        step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        p = np.repeat(period[a:b], own)
        yield np.repeat(starts[text[a:b]], own) + step * p, p
        a = b


def runs_of(texts: list[list[bytes]], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """For each text the runs as rows (start, length, period), by start, then period.

    A run is a stretch with smallest period q and at least max(``least``, 2q) words that can't be extended.
    The smallest of the periods found for a stretch is its smallest: any other is a multiple of it.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    levels = power_names(first_names(texts))
    found = [np.empty((0, 3), np.int64)]
    for i, p in _grid(starts, sizes) if levels else ():
        near = levels[0][i] == levels[0][i + p]
        i, p = i[near], p[near]
        before = _behind(levels, i, i + p)
        length = before + _ahead(levels, i, i + p) + p
        kept = length >= np.maximum(2 * p, least)
        found.append(np.stack([(i - before)[kept], length[kept], p[kept]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1))] if len(runs) else runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cut = np.searchsorted(runs[:, 0], np.append(starts, sizes.sum()))
    return [runs[a:b] - [s, 0, 0] for a, b, s in zip(cut[:-1], cut[1:], starts)]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words but those that a run holds after its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(id, runs, collapsed) of every row: its runs by start, then period, and the text without their repeats.

    Words are what white space parts (space and the controls 9 to 13). NULL and empty texts have no runs and
    an empty collapsed text. Texts are taken whole; no row needs another one, so nothing is shuffled. Repeated
    rows and NULL identifiers are rows like others; other columns are not read; an empty table stays empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def block(keys: list, texts: list[list[bytes]]) -> pd.DataFrame:
        runs = runs_of(texts, least)
        return pd.DataFrame({
            "id": pd.Series(keys, dtype=object),
            "runs": [[{"start": int(s), "length": int(n), "period": int(p)} for s, n, p in r] for r in runs],
            "collapsed": [b" ".join(collapse(t, r)).decode() for t, r in zip(texts, runs)],
        })

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch["id"].astype(object), batch["text"]):
                words = (text or "").encode().split()  # for bytes: exactly the six ASCII white-space characters
                if texts and size + len(words) > BLOCK_WORDS:
                    yield block(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(None if pd.isna(key) else key)
                texts.append(words)
                size += len(words)
        if texts:
            yield block(keys, texts)

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(find, f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) that the contract judges: of a tenth of the documents a tail is made periodic.

    The words are a column of their own, as a lambda that reads them would split the text once a word.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor((h - h % 10) / 10)
    split = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))).alias("words"))
    n = F.size("words")
    begun = split.withColumn("a", F.when(n > 0, F.col("g") % n))
    told = begun.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return told.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = periodic_runs(planted(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    length, start, period = F.col("_longest.length"), -F.col("_longest.start"), -F.col("_longest.period")
    return found.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * _longest.length div -_longest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words of a text, p apart, are joined; stretches of neighbouring pairs are the runs of period p.
ORACLE = r"""
WITH told AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) AS h
  FROM documents
), params AS (
  SELECT *, len(own) AS n, h // 10 AS g FROM told
), bounds AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM params
), periods AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM bounds
), texts AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN own ELSE list_transform(own, lambda w, i: CASE WHEN i - 1 < a THEN w ELSE own[1 + a + (i - 1 - a) % p] END) END AS words
  FROM periods
), placed AS MATERIALIZED (
  SELECT doc_id, n, unnest(words) AS w, unnest(range(n)) AS i FROM texts
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 2
), stretches AS (
  SELECT doc_id, p, min(i) AS s, count(*) + p AS m
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(12, 2 * p)
), runs AS MATERIALIZED (
  SELECT doc_id, s, m, min(p) AS q FROM stretches GROUP BY doc_id, s, m
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), summed AS (
  SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(s := s, m := m, q := q), (m, -s, -q)) AS best, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.m AS length, best.q AS period, 1000 * best.m // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
