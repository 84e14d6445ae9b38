"""Rollups and audits of call logs: costs, usage, limits, ceilings, repeats, alignment and memory decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses that count as executed, memory decay and expiry.
EXECUTED = ("success", "failure")
HALF_LIFE_DAYS, MIN_IMPORTANCE, EXPIRY_DAYS = 14.0, 0.2, 30.0


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``: an aggregate that combines before the shuffle, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of equal key, and its other rows added."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def missing(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return source.join(target.select(key), key, "left_anti")


#: Hex digits of a row's place in the checksum's tree, by level: 16^5 leaves, 16^2 nodes above them, one root.
TREE_DIGITS = (5, 2, 0)


def collection_checksum(rows: DataFrame, id_col: str, row_text: Column) -> DataFrame:
    """One row: SHA-256 of a tree over all rows.

    A row's leaf is named by the first digits of its identifier's MD5, whatever the identifier's type and
    size. A leaf hashes its rows' digests in order of identifier, a node its children's in order of name;
    leaves hold a few thousand digests for thousands of millions of rows, nodes 4,096 at most. Rows that
    repeat an identifier are ordered by digest; NULL identifiers count as empty; without rows the digest is
    that of the empty string. A single chain over all rows would need one task for all of them.
    """
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    now = rows.select(F.col(id_col).alias("at"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("node"), digest(row_text).alias("digest"))
    for digits in TREE_DIGITS[:-1]:
        ordered = F.array_sort(F.collect_list(F.struct("at", "digest")))
        joined = F.array_join(F.transform(ordered, lambda x: x["digest"]), "")
        now = now.groupBy(F.substring("node", 1, digits).alias("node")).agg(digest(joined).alias("digest")).select(F.col("node").alias("at"), "node", "digest")
    ordered = F.array_sort(F.collect_list(F.struct("at", "digest")))
    return now.agg(digest(F.array_join(F.transform(ordered, lambda x: x["digest"]), "")).alias("digest"))


def ordered_checksums(rows: DataFrame, by: list[str], id_col: str, row_text: Column) -> DataFrame:
    """(by..., n, digest): SHA-256 over the binary row digests of each group in order of the identifier.

    One chain a group, so a group must fit a task: a digest is 32 bytes. For whole collections of any size
    use :func:`collection_checksum`.
    """
    digest = F.unhex(F.sha2(F.coalesce(row_text, F.lit("")).cast("binary"), 256))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("at"), digest.alias("digest"))))
    chain = F.aggregate(ordered, F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["digest"]))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sha2(chain, 256).alias("digest"))


def task_types(calls: DataFrame, task: str, kind: str) -> DataFrame:
    """(task, type): its different kinds, sorted and joined by +."""
    return calls.groupBy(task).agg(F.array_join(F.array_sort(F.collect_set(kind)), "+").alias("type"))


def usage(calls: DataFrame, tool: str, status: str, statuses: list[str]) -> DataFrame:
    return calls.groupBy(tool).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses], F.count(F.lit(1)).alias("total"))


def over_limit(calls: DataFrame, task: str, tool: str, status: str, order: list[str], limit: int) -> DataFrame:
    """Executed calls of a task and tool beyond ``limit``, with their number."""
    number = F.row_number().over(Window.partitionBy(task, tool).orderBy(*order))
    return calls.where(F.col(status).isin(*EXECUTED)).withColumn("number", number).where(F.col("number") > limit)


def over_ceiling(calls: DataFrame, task: str, cost: str, order: list[str], max_calls: int, max_cost: float) -> DataFrame:
    """Calls that a task should not have been let make: the calls or the cost before them reached a ceiling.

    Costs are added as decimals of twelve places, so ten calls at 0.1 have reached 1; a task with a cost that isn't
    finite or beyond them is added in doubles.
    """
    before = Window.partitionBy(task).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    exact = F.col(cost).try_cast("decimal(28,12)")
    rough = F.count_if(F.col(cost).isNotNull() & exact.isNull()).over(before) > 0
    spent = F.when(rough, F.sum(F.col(cost).cast("double")).over(before)).otherwise(F.sum(exact).over(before).cast("double"))
    counted = calls.withColumn("calls_before", F.count(F.lit(1)).over(before)).withColumn("cost_before", F.coalesce(spent, F.lit(0.0)))
    return counted.where((F.col("calls_before") >= max_calls) | (F.col("cost_before") >= max_cost))


def repeat_share(calls: DataFrame, task: str, same: list[str]) -> DataFrame:
    """(task, n, repeats, share): calls that another of the task's calls equals and precedes."""
    kinds = calls.groupBy(task, *same).agg(F.count(F.lit(1)).alias("n"))
    totals = kinds.groupBy(task).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeats"))
    return totals.withColumn("share", F.col("repeats") / F.col("n"))


def aligned(left: DataFrame, right: DataFrame, pair: str, agent: str, prompt: str, order: str) -> DataFrame:
    """(pair, agent, sha, k, in_left, in_right): calls matched by agent, prompt and occurrence."""

    def keyed(df: DataFrame, flag: str) -> DataFrame:
        own = df.select(pair, agent, F.sha2(F.col(prompt).cast("binary"), 256).alias("sha"), order)
        k = F.row_number().over(Window.partitionBy(pair, agent, "sha").orderBy(order))
        return own.withColumn("k", k).drop(order).withColumn(flag, F.lit(True))

    both = keyed(left, "in_left").join(keyed(right, "in_right"), [pair, agent, "sha", "k"], "full")
    return both.fillna(False, ["in_left", "in_right"])


def rendered(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, rendered): one [role] block a message, in order, parted by blank lines."""
    block = F.concat(F.lit("["), F.col(role), F.lit("] "), F.coalesce(F.col(text), F.lit("")))
    return messages.groupBy(conversation).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("at"), block.alias("block")))), lambda x: x["block"]), "\n\n").alias("rendered")
    )


def importance(accesses: Column, age_days: Column) -> Column:
    return (1 + accesses) * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / HALF_LIFE_DAYS)


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, wave) of a plan: a node's wave is its longest chain of dependencies (``edges``: id, depends_on).

    Plans are small and acyclic; a cycle runs into Spark's recursion limit and raises.
    """
    return nodes.sparkSession.sql(
        """WITH RECURSIVE w(id, wave) AS (
             SELECT id, 0 FROM {nodes} UNION ALL SELECT e.id, w.wave + 1 FROM w JOIN {edges} e ON e.depends_on = w.id)
           SELECT id, max(wave) AS wave FROM w GROUP BY id""", nodes=nodes, edges=edges,
    )
