"""Embedding near-duplicates with a pivot-permutation index.

A vector is described by its nearest reference points (pivots). Every set of ``shared`` pivots among its
``nearest`` is an entry of the inverted lists, so two vectors that share as many pivots meet on a list.
Each pair is counted on one list only, that of the least pivots the two share, and is then verified by its
cosine in double precision. Long lists are cut into blocks and compared block against block; a block
sends a number and one link a vector, never its pairs. The number of pivots grows with the cube root of the
number of vectors: lists are named by three pivots, so their length stays as it is. Vectors of different
lengths (numbers of components) never meet; each length has pivots of its own, and a length of few vectors
is one list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.graph import connected_components
from siftmill.llm.storage import remove, written, written_at

#: Pivots that share a list.
SHARED = 3
#: Pivots at BASE_ROWS vectors, and the least and most of them. The most is reached at 2e8 vectors.
PIVOTS, BASE_ROWS, LEAST_PIVOTS, MOST_PIVOTS = 512, 50_000, 128, 8192
#: Vectors that the pivots are chosen from, at least: a bounded sample by a hash of the vector, 8 for each pivot.
SAMPLE = 4096
#: Most vectors of one list that are compared at once with as many others, and rows of one such product.
BLOCK, ROWS = 2048, 256


def pivots_for(rows: int) -> int:
    return max(LEAST_PIVOTS, min(MOST_PIVOTS, round(PIVOTS * (rows / BASE_ROWS) ** (1 / 3))))


def nearest_for(pivots: int) -> int:
    """Pivots that describe a vector: seven where they lie dense, as then neighbours differ in more of them."""
    return 6 if pivots <= 1024 else 7


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Unit vectors of the sample, each the one farthest from those before it: a crowd yields few of them."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, closest = [0], unit @ unit[0]
    while len(chosen) < min(pivots, len(unit)):
        chosen.append(int(np.argmin(closest)))
        closest = np.maximum(closest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(class_id, copies, vector) of each different usable vector."""
    ok = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(
        "id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 "
        "AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)"
    )
    return written(ok.groupBy("vector").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "vectors")


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(unit: np.ndarray, side: np.ndarray | None, pivots: np.ndarray, names: np.ndarray, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs, each in both orders, some rows of the product at a time."""
    has = (pivots[:, :, None] == names[None, None, :]).any(1).astype(np.float32) if len(names) else None
    found = []
    for at in range(0, len(unit), ROWS):
        close = unit[at : at + ROWS] @ unit.T >= threshold
        if side is None:
            close[np.arange(len(close)), np.arange(at, at + len(close))] = False
        else:
            close &= side[at : at + ROWS, None] != side[None, :]
        if has is not None and close.any():  # pairs whose least shared pivots make up this very list
            close &= has[at : at + ROWS] @ has.T == shared
        a, b = np.nonzero(close)
        found.append((a + at, b))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _compare(group: pd.DataFrame, low: int, high: int, named: list[int], threshold: float) -> tuple[list, list, list]:
    """(class_id, links, root) of the vectors of two blocks of a list that have a link between them."""
    ids, copies, block = (group[c].to_numpy() for c in ("class_id", "copies", "block"))
    pivots = np.stack(group["pivots"].to_numpy())
    names = np.unique(pivots[pivots <= named[-1]]) if len(named) else np.array([], np.int32)
    a, b = _links(_unit(group["vector"].to_numpy()), None if low == high else block, pivots, names, threshold, len(named))
    if not len(a):
        return [], [], []
    links = np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(ids))
    while True:  # least labels over links, then along labels, until none falls
        lower = rank.copy()
        np.minimum.at(lower, a, rank[b])
        lower = lower[order[lower]]
        if (lower == rank).all():
            break
        rank = lower
    linked = np.flatnonzero(links)
    return ids[linked].tolist(), links[linked].tolist(), ids[order[rank[linked]]].tolist()


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    pivots: int | None = None, nearest: int | None = None, shared: int = SHARED, sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Equal vectors are one class and linked to each other. Vectors that are NULL, empty or zero, that hold
    NULL or non-finite components, or whose identifier is NULL link with nothing: no links, their own
    component. Vectors link with those of their own length only. Repeated rows count as links of each other.
    An empty table gives an empty result; other columns are not read. By default the pivots and how many of
    them describe a vector follow from the number of vectors of a length.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    classes = _classes(vectors, id_col, vector_col)
    # lengths of more vectors than a block: as many numbers as there are such lengths
    lengths = classes.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block if pivots is None else F.lit(True)).collect()
    points, width = {}, {}
    for r in lengths:
        wanted = pivots or pivots_for(r["rows"])
        own = classes.where(F.size("vector") == r["n"])
        picked = own.orderBy(F.xxhash64("vector"), "class_id").select("vector").limit(max(sample, 8 * wanted)).collect()
        points[r["n"]] = choose_pivots(np.array([p["vector"] for p in picked], np.float64), wanted)
        width[r["n"]] = min(nearest or nearest_for(wanted), len(points[r["n"]]))
    shared = min([shared, *width.values()])
    kind = classes.schema["class_id"].dataType.simpleString()

    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = [np.array([], np.int32)] * len(batch)
            sizes = np.array([len(v) for v in batch], np.int64)
            for n in np.unique(sizes):
                if int(n) in points:
                    at = np.flatnonzero(sizes == n)
                    order = np.argsort(-(_unit(batch.iloc[at].to_numpy()) @ points[int(n)].T), axis=1, kind="stable")
                    for i, own in zip(at, np.sort(order[:, : width[int(n)]], axis=1).astype(np.int32)):
                        out[i] = own
            yield pd.Series(out, dtype=object)

    describe.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    described, described_at = written_at(classes.withColumn("pivots", F.pandas_udf(describe, "array<int>")(F.col("vector"))), "described")

    # a list is named by the length and its pivots; a length without pivots is one list
    size = F.size("vector")
    named = F.array(F.array(size))
    for n in sorted(set(width.values())):
        lists = F.array(*[F.array(size, *[F.col("pivots")[i] for i in c]) for c in combinations(range(n), shared)])
        named = F.when(F.size("pivots") == n, lists).otherwise(named)
    entries = described.select("class_id", F.explode(named).alias("list"))
    long_lists, lists_at = written_at(
        entries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "lists",
    )
    mine = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    placed = entries.join(long_lists, "list").select("class_id", "list", mine.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("class_id", "list", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = placed.join(described, "class_id").repartition("list", "low", "high").sortWithinPartitions("list", "low", "high", "class_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups():
            rest = None
            for batch in batches:
                if not len(batch):
                    continue
                batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
                keys = [(tuple(a), b, c) for a, b, c in zip(batch["list"], batch["low"], batch["high"])]
                starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
                for a, b in zip(starts, starts[1:]):
                    yield keys[a], batch.iloc[a:b]
                rest = batch.iloc[starts[-1] :]
            if rest is not None:
                yield (tuple(rest["list"].iloc[0]), rest["low"].iloc[0], rest["high"].iloc[0]), rest

        found: tuple[list, list, list] = ([], [], [])
        for (own, low, high), group in groups():
            if len(group) > 1:
                for to, more in zip(found, _compare(group, low, high, own[1:], threshold)):
                    to.extend(more)
            if len(found[0]) > 10_000:
                yield pd.DataFrame(dict(zip(("class_id", "links", "root"), found)))
                found = ([], [], [])
        if found[0]:
            yield pd.DataFrame(dict(zip(("class_id", "links", "root"), found)))

    links, links_at = written_at(rows.select("class_id", "copies", "vector", "pivots", "list", "block", "low", "high").mapInPandas(verify, f"class_id {kind}, links long, root {kind}"), "links")
    for at in (described_at, lists_at):
        remove(spark, at)
    roots = connected_components(links, "class_id", "root")
    counts = links.groupBy("class_id").agg(F.sum("links").alias("links"))
    told = classes.join(counts, "class_id", "left").join(roots, F.col("class_id") == F.col("node"), "left").select(
        F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("root_id"),
    )
    told = written(told, "told")  # so that the last join deals both sides anew and a frequent vector can be split
    remove(spark, links_at)
    joined = base.join(told, (F.col("vector") == F.col("_vector")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("root_id", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


ORACLE = """WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM u
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""


def op6_pivot_index(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
