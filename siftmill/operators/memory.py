"""Near-duplicates within a memory: greedy acceptance and components of the similarity graph.

Vectors of a memory are dealt into blocks of bounded size, and two blocks are compared at a time, so a task
holds two blocks of one memory and sends on only the pairs over the threshold. A memory is one owner's
notes; comparing within it is quadratic in its size, not in the table's.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.sources.tables import written

#: Vectors of a memory compared at once with as many others.
BLOCK = 1024


def _spanning(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each linked row b with the first row a of its component, of an upper triangle of links."""
    reach = close | close.T | np.eye(len(close), dtype=bool)
    least = np.arange(len(close))
    while True:
        lower = np.where(reach, least[None, :], len(close)).min(1)
        lower = lower[lower]
        if (lower == least).all():
            break
        least = lower
    b = np.flatnonzero(least < np.arange(len(close)))
    return least[b], b


def similar_pairs(rows: DataFrame, group: list[str], id_col: str, vector_col: str, threshold: float, strict: bool = False, block: int = BLOCK, spanning: bool = False) -> DataFrame:
    """(group columns, a, b) with a < b: pairs of one group whose cosine reaches (``strict``: exceeds) the threshold.

    Rows with a NULL identifier or vector, or a zero vector, are in no pair. Rows must have unique identifiers
    within their group. An empty table gives an empty result. ``spanning`` leaves only links that connect
    the same rows: each row to the least one it reaches among the two blocks compared, so a crowd of n alike
    rows gives n links a comparison and not n² / 2.
    """
    names = [f"_g{i}" for i in range(len(group))]
    own = rows.select(*[F.col(c).alias(n) for c, n in zip(group, names)], F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.where("id IS NOT NULL AND vector IS NOT NULL AND exists(vector, x -> x <> 0)")
    counted = own.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sizes = counted.select(*[F.col(n).alias(f"_{n}") for n in names], "blocks")
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    placed = own.join(sizes, same).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*names, "id", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), f"a {kinds['id']}", f"b {kinds['id']}"])

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable", ignore_index=True)
        x = np.stack(part["vector"].to_numpy())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        cosines = x @ x.T
        close = np.triu(cosines > threshold if strict else cosines >= threshold, 1)
        if part["low"].iloc[0] != part["high"].iloc[0]:
            side = part["block"].to_numpy()
            close &= side[:, None] != side[None, :]
        a, b = _spanning(close) if spanning else np.nonzero(close)
        out = {n: pd.Series([part[n].iloc[0]] * len(a), dtype=object) for n in names}  # pandas' own string type comes in chunks
        return pd.DataFrame(out | {"a": part["id"].to_numpy()[a], "b": part["id"].to_numpy()[b]})

    pairs = dealt.groupBy(*names, "low", "high").applyInPandas(compare, schema)
    return pairs.select(*[F.col(n).alias(c) for c, n in zip(group, names)], "a", "b")


def greedy_kept(rows: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``kept``: in order of the identifier, a row stays unless it is paired with an earlier one that stays.

    Each round settles every row whose earlier partners are settled: with a kept one it goes, with none but
    dropped ones it stays. At least the least open row is settled each round; long chains take as many
    rounds as they have links. Rounds are written to the shared folder, the driver reads one count.
    """
    state = written(rows.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("kept", F.lit(None).cast("boolean")), "greedy")
    links = written(pairs.select("a", "b").distinct(), "links")
    while state.where("kept IS NULL").limit(1).count():
        earlier = links.join(state.select(F.col("id").alias("a"), F.col("kept").alias("a_kept")), "a").groupBy("b").agg(
            F.max(F.coalesce("a_kept", F.lit(False))).alias("beaten"), F.max(F.col("a_kept").isNull()).alias("open")
        )
        told = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = written(state.join(earlier, F.col("id") == F.col("b"), "left").select("id", told.alias("kept")), "greedy")
    joined = rows.join(state.select(F.col("id").alias("_id"), F.col("kept")), F.col(id_col) == F.col("_id"), "left").drop("_id")
    return joined.withColumn("kept", F.coalesce("kept", F.lit(True)))


def components(rows: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``component``: the least identifier reachable over pairs, itself included.

    Least labels are passed on to neighbours and then along labels (pointer jumping) until none falls.
    """
    both = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = written(rows.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("label", F.col("id")), "labels")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        least = now.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("before"), F.least("label", "theirs").alias("label"))
        jump = least.select(F.col("id").alias("label"), F.col("label").alias("further"))
        later = written(least.join(jump, "label").select("id", "before", F.least("label", "further").alias("label")), "labels")
        if not later.where("label <> before").limit(1).count():
            break
        now = later.select("id", "label")
    return rows.join(later.select(F.col("id").alias("_id"), F.col("label").alias("component")), F.col(id_col) == F.col("_id"), "left").drop("_id")
