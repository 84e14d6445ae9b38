"""The line of a text that holds the most of a quote in order: where a near-miss came from.

What a line holds of a quote is the sum of their matching blocks: the longest common stretch (the first in the line,
then in the quote, of equally long ones), and the same again on either side of it. Lines are rows dealt over tasks,
whatever text they are of. A line can't hold more of a quote than the letters that both have, so a task looks at lines by that
bound and stops where it falls below the best one found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.functions import text as T

#: Tasks that the lines of one quote are dealt to at most.
SALT = 16


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _longest(line: str, quote: str) -> tuple[int, int, int]:
    """The longest common stretch of two texts: its length, where it begins in the line (the first) and in the quote (the first).

    A stretch of a length is looked up among the quote's of that length; lengths are doubled, then halved in between.
    """

    def first(n: int) -> int:
        known = {quote[i : i + n] for i in range(len(quote) - n + 1)}
        return next((i for i in range(len(line) - n + 1) if line[i : i + n] in known), -1)

    if quote in line:
        return len(quote), line.find(quote), 0
    most, least, at, n = min(len(line), len(quote)), 0, -1, 1
    while n <= most:
        found = first(n)
        if found < 0:
            most = n - 1
        else:
            least, at, n = n, found, 2 * n
    while least < most:
        n = (least + most + 1) // 2
        found = first(n)
        least, at, most = (n, found, most) if found >= 0 else (least, at, n - 1)
    return least, at, quote.find(line[at : at + least]) if least else 0


def held(line: np.ndarray, quote: np.ndarray) -> int:
    """Characters of the matching blocks of two texts given as code points."""
    total, parts = 0, [tuple(x.tobytes().decode("utf-32-le") for x in (line, quote))]
    while parts:
        a, b = parts.pop()
        n, i, j = _longest(a, b)
        if n:
            total += n
            parts += [p for p in ((a[:i], b[:j]), (a[i + n :], b[j + n :])) if p[0] and p[1]]
    return total


def _most(line: np.ndarray, letters: np.ndarray, counts: np.ndarray) -> int:
    """Characters that a line and a quote's letters have in common, in any order."""
    own, n = np.unique(line, return_counts=True)
    at = np.searchsorted(letters, own)
    known = at < len(letters)
    at, n, own = at[known], n[known], own[known]
    same = letters[at] == own
    return int(np.minimum(counts[at[same]], n[same]).sum())


def closest_lines(pairs: DataFrame, keys: list[str], quote: str, text: str) -> DataFrame:
    """(keys..., line, text, score) of the closest line of each pair's text, white space normalised; lines are numbered from 1.

    The score is the share of the quote's characters that the line holds; of equal lines the first stands. Pairs
    without a quote or a line that isn't empty have no row. ``keys`` must tell the pairs apart.
    """
    lines = pairs.select(*keys, T.normalize_ws(F.col(quote)).alias("_quote"), F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    lines = lines.select(*keys, "_quote", (F.col("_at") + 1).alias("line"), T.normalize_ws(F.col("_line")).alias("text")).where("_quote <> '' AND text <> ''")
    fields = ", ".join(f"`{k}` {dict(pairs.dtypes)[k]}" for k in keys)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, group in batch.groupby([*keys, "_quote"], dropna=False, sort=False):
                quote = _codes(group["_quote"].iloc[0])
                letters, counts = np.unique(quote, return_counts=True)
                coded = [_codes(t) for t in group["text"]]
                bounds = np.array([_most(x, letters, counts) for x in coded])
                top = (-1, 0, 0)
                for i in np.argsort(-bounds, kind="stable"):
                    if bounds[i] < top[0]:
                        break
                    top = max(top, (held(coded[i], quote), -int(group["line"].iloc[i]), int(i)))
                own = group.iloc[top[2]]
                rows.append((*own[keys], own["line"], own["text"], top[0] / len(quote)))
            yield pd.DataFrame(rows, columns=[*keys, "line", "text", "score"])

    dealt = lines.repartition(*keys, F.pmod(F.xxhash64("line"), F.lit(SALT)))
    found = dealt.mapInPandas(best, f"{fields}, line int, text string, score double")
    return found.groupBy(*keys).agg(F.max(F.struct("score", -F.col("line"), "text")).alias("_best")).select(
        *keys, (-F.col("_best.col2")).alias("line"), "_best.text", "_best.score"
    )
