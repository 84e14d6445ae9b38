"""A kept inverted file of vectors: coarse centroids, a list of vectors a centroid, probes, and exact bounds.

Centroids come from k-means over a bounded sample; every vector is in the list of its nearest centroid, and
each list keeps the widest angle between its centroid and a vector of it. A search compares a query with the
lists of its nearest centroids (``probes``: approximate) or with every list that its angle doesn't rule out:
a vector within an angle a of the query lies in a list whose centroid is within a plus the list's own angle,
so a search by threshold is exact whatever the centroids. Stored vectors are never compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.sources.tables import written

#: Vectors that centroids are fitted on, bounded by rows and by bytes; and the rounds of k-means.
SAMPLE, SAMPLE_BYTES, ROUNDS = 16_384, 1 << 26, 8
#: Lists at most: what a task holds of the centroids is this many vectors. Fewer: the root of the vectors' number.
MOST_LISTS = 4096
#: Vectors of a list compared at once, with so many queries (a task has 2^21 cosines at a time); bytes of vectors that a
#: task sends on at a time. Queries are many where lists are within reach of all of them, so their blocks are larger:
#: a list's vectors are sent once a block of queries.
BLOCK, ASKED_BLOCK, SENT_BYTES = 256, 8192, 1 << 22
#: Added to angles, against rounding.
SLACK = 1e-6


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that a cosine is defined for."""
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(finite & F.exists("vector", lambda x: x != 0))


def fit(vectors: DataFrame, lists: int | None = None) -> np.ndarray:
    """Unit centroids of (id, vector): spherical k-means of the sample of the least hashed identifiers."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return np.empty((0, 0))
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    sample = np.array([r["vector"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(rows).collect()])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    different = np.unique(sample, axis=0)
    k = min(lists or max(1, math.isqrt(n)), MOST_LISTS, len(different))
    centres = different[np.random.default_rng(0).permutation(len(different))[:k]]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


class NeighbourIndex:
    """An inverted file in the folder ``path``. Identifiers must be different; vectors of one length.

    Rows without an identifier, and vectors that are NULL, zero or hold NULL or non-finite components, are in
    no list and find nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.centres = np.empty((0, 0))

    def build(self, rows: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", lists: int | None = None) -> NeighbourIndex:
        """Fits the centroids and adds the rows."""
        self.centres = fit(_usable(rows, id_col, vector_col), lists)
        kind = dict(rows.dtypes)[id_col]
        self.spark.createDataFrame([(c.tolist(),) for c in self.centres], "centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        self.spark.createDataFrame([], f"id {kind}, vector array<double>, list int").write.parquet(f"{self.path}/vectors")
        self.spark.createDataFrame([], "list int, least double, n long").write.parquet(f"{self.path}/lists")
        self.add(rows, id_col, vector_col)
        return self

    def open(self) -> NeighbourIndex:
        """Reads the centroids of a kept index: a bounded number of rows."""
        self.centres = np.array([r["centre"] for r in self.spark.read.parquet(f"{self.path}/centres").collect()])
        return self

    def add(self, rows: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding") -> None:
        """Puts new vectors into their lists; the centroids stay."""
        if not len(self.centres):
            return
        placed = self._listed(_usable(rows, id_col, vector_col), lambda cosines: [[int(i)] for i in cosines.argmax(1)])
        at = f"{self.path}/added-{self.spark.read.parquet(f'{self.path}/lists').count()}"
        placed.write.mode("overwrite").parquet(at)
        added = self.spark.read.parquet(at)
        centres = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "list int, centre array<double>")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        cosine = dot("vector", "centre") / F.sqrt(dot("vector", "vector"))
        added.join(centres, "list").groupBy("list").agg(F.min(cosine).alias("least"), F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{self.path}/lists")
        added.repartition("list", F.pmod(F.xxhash64("id"), F.lit(64))).write.mode("append").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def lists(self) -> DataFrame:
        """(list, least, n): the least cosine with the centroid and the number of vectors; a bounded table."""
        return self.spark.read.parquet(f"{self.path}/lists").groupBy("list").agg(F.min("least").alias("least"), F.sum("n").alias("n"))

    def _listed(self, own: DataFrame, choose) -> DataFrame:
        """(id, vector, list): each vector once for each list that ``choose`` names for its cosines with the centroids."""
        centres, kind = self.centres, dict(own.dtypes)["id"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    part = batch.iloc[at : at + BLOCK]
                    x = np.stack(part["vector"].to_numpy())
                    chosen = choose(x / np.linalg.norm(x, axis=1, keepdims=True) @ centres.T)
                    rows = np.repeat(np.arange(len(part)), [len(c) for c in chosen])
                    lists = np.array([i for c in chosen for i in c], np.int32)
                    step = max(1, SENT_BYTES // (8 * x.shape[1]))  # a vector in many lists is many rows
                    for i in range(0, len(rows), step):
                        yield part.iloc[rows[i : i + step]].assign(list=lists[i : i + step])

        return own.mapInPandas(run, f"id {kind}, vector array<double>, list int")

    def _compared(self, asked: DataFrame, pick) -> DataFrame:
        """What ``pick`` (ids, queries, cosines) gives for each block of a list's vectors and queries.

        Lists are cut into blocks by the number of their vectors and of their queries, so a hot list is many tasks.
        """
        kind, asked_kind = dict(self.vectors().dtypes)["id"], dict(asked.dtypes)["id"]
        parts = lambda n, block: F.ceil(F.col(n) / block).cast("int")
        sizes = self.lists().join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("asked")), "list").select("list", parts("n", BLOCK).alias("rows"), parts("asked", ASKED_BLOCK).alias("columns"))
        sizes = F.broadcast(sizes)  # a row a list, MOST_LISTS at most

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            cut = df.join(sizes, "list").withColumn(own[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
            return cut.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("list", "r", "c", "id", "vector")

        def compare(stored: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            if not len(stored) or not len(queries):
                return pd.DataFrame(columns=["query", "id", "score"])
            unit = lambda df: (x := np.stack(df["vector"].to_numpy())) / np.linalg.norm(x, axis=1, keepdims=True)
            stored = stored.sort_values("id", kind="stable")
            q, s, score = pick(stored["id"].to_numpy(), queries["id"].to_numpy(), unit(queries) @ unit(stored).T)
            return pd.DataFrame({"query": queries["id"].to_numpy()[q], "id": stored["id"].to_numpy()[s], "score": score})

        keys = ["list", "r", "c"]
        left, right = dealt(self.vectors(), "rows", "columns").groupBy(*keys), dealt(asked, "columns", "rows").groupBy(*keys)
        return left.cogroup(right).applyInPandas(compare, f"query {asked_kind}, id {kind}, score double")

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "chunk_id", vector_col: str = "embedding", others: bool = False) -> DataFrame:
        """(query, id, score): the k best by (cosine desc, id) of each query; exact without ``probes``.

        With ``probes`` only that many lists a query are read. ``others`` leaves out the query's own identifier.
        Each block sends k rows a query at most.
        """
        if not len(self.centres):
            return self.spark.createDataFrame([], f"query {dict(queries.dtypes)[id_col]}, id {dict(queries.dtypes)[id_col]}, score double")
        some = min(probes or len(self.centres), len(self.centres))
        asked = self._listed(_usable(queries, id_col, vector_col), lambda cosines: np.argsort(-cosines, axis=1, kind="stable")[:, :some].tolist())

        def best(ids: np.ndarray, own: np.ndarray, cosines: np.ndarray) -> tuple:
            if others:
                cosines = np.where(own[:, None] == ids[None, :], -np.inf, cosines)
            at = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
            score = np.take_along_axis(cosines, at, axis=1)
            q, j = np.nonzero(score > -np.inf)
            return q, at[q, j], score[q, j]

        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return self._compared(asked, best).withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", "score")

    def above(self, queries: DataFrame, threshold: float, id_col: str = "chunk_id", vector_col: str = "embedding", earlier: bool = False, probes: int | None = None, once: bool = False) -> DataFrame:
        """(query, id, score) of all pairs above the threshold, exactly; lists out of reach are not read.

        ``earlier``: only pairs with the stored identifier below the query's, for queries that are stored too.
        ``probes``: only of so many lists, the nearest; ``once``: one pair of a query and block of vectors is enough.
        """
        if not len(self.centres):
            return self.spark.createDataFrame([], f"query {dict(queries.dtypes)[id_col]}, id {dict(queries.dtypes)[id_col]}, score double")
        reach = math.acos(max(-1.0, min(1.0, threshold)))
        widest = np.full(len(self.centres), -np.inf)
        for r in self.lists().collect():  # MOST_LISTS at most
            widest[r["list"]] = math.acos(max(-1.0, min(1.0, r["least"])))

        def near(cosines: np.ndarray) -> list[list[int]]:
            within = np.arccos(np.clip(cosines, -1, 1)) <= reach + widest[None, :] + SLACK
            if probes:
                return [own[within[i, own]].tolist() for i, own in enumerate(np.argsort(-cosines, axis=1, kind="stable")[:, :probes])]
            return [np.flatnonzero(row).tolist() for row in within]

        def over(ids: np.ndarray, own: np.ndarray, cosines: np.ndarray) -> tuple:
            hit = cosines > threshold
            if earlier:
                hit &= ids[None, :] < own[:, None]
            if once:
                q = np.flatnonzero(hit.any(1))
                s = hit[q].argmax(1)
                return q, s, cosines[q, s]
            q, s = np.nonzero(hit)
            return q, s, cosines[q, s]

        return self._compared(self._listed(_usable(queries, id_col, vector_col), near), over)

    def beaten(self, queries: DataFrame, threshold: float, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
        """(query): those above the threshold with a stored vector, exactly. Each asks its nearest list; only those
        that are above nothing there go to the other lists in reach."""
        ask = lambda rows, probes: self.above(rows, threshold, id_col, vector_col, probes=probes, once=True).select("query").distinct()
        first = written(ask(queries, 1), "beaten")
        return first.union(ask(queries.join(first, queries[id_col] == first["query"], "left_anti"), None))
