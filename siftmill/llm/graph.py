"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.storage import remove, written_at


def _stars(pairs: DataFrame, keep_larger_only: bool) -> DataFrame:
    """Each neighbour of u is linked to the least of u and its neighbours.

    The least is a map-side-combined aggregate joined back, not a window, so a hub with many neighbours
    is dealt over several tasks: its rows only meet in a join that adaptive execution can split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    joined = pairs.join(least, "u")
    if keep_larger_only:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the least node that each node of an edge reaches; nodes without edges don't appear.

    Edges may repeat, be given in either direction or be loops. NULL ends are dropped. Each round is
    written to the shared folder, and the driver reads one row of totals to see whether it changed.
    """
    now, now_at = written_at(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True).where(F.col("u") != F.col("v")).distinct()
        small = _stars(large, False).where(F.col("u") != F.col("v")).distinct()
        before_at = now_at
        now, now_at = written_at(small, "edges")
        remove(edges.sparkSession, before_at)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.countDistinct("u")).first()
        if state[0] == state[2] and mark == state[:2]:
            break
        mark = state[:2]
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
