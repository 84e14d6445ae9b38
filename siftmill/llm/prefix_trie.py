"""The prefix trie of conversations by distributed most-significant-digit radix partitioning.

Turns are encoded by a dictionary: a number for each different (role, text), so a conversation is an array of
numbers. Equal conversations are one sequence with a count. From the root on, the sequences of a bucket are
dealt by their next number; a bucket of few turns is finished in one task by multikey quicksort, which emits
its nodes as it recurses, and a larger one is dealt again behind all that its sequences share: the least and
the greatest sequence of a bucket tell its common prefix, so a long shared beginning costs one round and not
one a turn. What subtrees add up to is then carried up from the deepest round to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.storage import remove, word_count, written, written_at

#: Turns (behind the bucket's prefix) that one task finishes at a time; a single sequence is always finished.
LOCAL_TURNS = 1 << 12
#: Identifiers of a class in one row of text, on the way to its hash.
CHUNK = 1 << 14

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = [f.split()[0] for f in NODE.split(", ")]


def encode(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, codes, words): each conversation's turns in order, as numbers of the dictionary and word counts.

    NULL roles and texts are empty. Turns are ordered by ``turn``, NULL first; those of one number by the SHA-256
    of role and text. Rows without a conversation belong to none. Texts are only hashed: what is shuffled is the
    hash, and the dictionary gives each different one a number. A conversation's numbers are one row.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    hashed = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), word_count(text).alias("words"),
    )
    hashed, hashed_at = written_at(hashed, "turns")
    numbers, numbers_at = written_at(hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).select("digest", F.monotonically_increasing_id().alias("code")), "dictionary")
    placed = F.struct(F.col("turn").isNotNull().alias("told"), "turn", "digest", "code", "words")
    whole = hashed.join(numbers, "digest").groupBy("conv_id").agg(F.array_sort(F.collect_list(placed)).alias("turns"))
    out = written(whole.select("conv_id", F.col("turns.code").alias("codes"), F.col("turns.words").alias("words")), "sequences")
    for at in (hashed_at, numbers_at):
        remove(turns.sparkSession, at)
    return out


def rebuilt(sequences: DataFrame) -> DataFrame:
    """The conversations that the contract judges: the first turns of a conversation come from that of its twenty."""
    none = F.array().cast("array<bigint>")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    heads = sequences.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("codes", 1, 3).alias("head_codes"), F.slice("words", 1, 3).alias("head_words"))
    joined = sequences.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left")
    own = [F.concat(F.slice(F.coalesce(f"head_{c}", none), F.lit(1), h), F.slice(c, h + 1, F.greatest(F.size(c), F.lit(1)))).alias(c) for c in ("codes", "words")]
    return joined.select("conv_id", *own)


def _hashes_of_classes(members: DataFrame) -> DataFrame:
    """(least, ends): the SHA-256 of each class's identifiers, ascending and comma-joined.

    A hash runs over its bytes in order, but no task gets the rows of a large class: ranges of identifiers are
    first joined to texts of up to CHUNK of them, and these are streamed in order through the class's hash.
    """

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, held, out = None, 0, [], []

        def flush() -> None:
            nonlocal number, held
            if held:
                out.append((key, part, number, ",".join(held)))
                number, held = number + 1, []

        part = 0
        for batch in batches:
            for least, conv, at in zip(batch["least"].tolist(), batch["conv_id"].tolist(), batch["part"].tolist()):
                if (least, at) != (key, part) or len(held) >= CHUNK:
                    flush()
                    key, part = least, at
                held.append(str(conv))
            yield pd.DataFrame(out, columns=["least", "part", "number", "text"])
            out = []
        flush()
        yield pd.DataFrame(out, columns=["least", "part", "number", "text"])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for least, text in zip(batch["least"].tolist(), batch["text"]):
                if least != key or state is None:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = least, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield pd.DataFrame(out, columns=["least", "ends"])
        yield pd.DataFrame([] if state is None else [(key, state.hexdigest())], columns=["least", "ends"])

    ranged = members.repartitionByRange("conv_id").sortWithinPartitions("least", "conv_id").withColumn("part", F.spark_partition_id())
    texts = ranged.mapInPandas(chunks, "least long, part long, number long, text string")
    return texts.repartition("least").sortWithinPartitions("least", "part", "number").mapInPandas(hashes, "least long, ends string")


def classes_of(sequences: DataFrame) -> DataFrame:
    """(least, n, codes, words, ends): the different sequences, the least conversation and the number of each."""
    classes = written(sequences.groupBy("codes").agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("words").alias("words")), "classes")
    shared = classes.where("n > 1").select("codes", "least")
    ends = _hashes_of_classes(sequences.join(shared, "codes").select("least", "conv_id"))
    own = F.coalesce("ends", F.sha2(F.col("least").cast("string"), 256))
    return classes.join(ends, "least", "left").select("least", "n", "codes", "words", own.alias("ends"))


def multikey_nodes(codes: list, words: list, counts: list, least: list, ends: list, depth: int, top: int) -> list[list]:
    """Nodes (rows of NODE) of sequences that share their first ``depth + 1`` codes, from that depth on.

    Multikey quicksort with a stack: the members of a part share a prefix, whose node is known; those with a
    smaller, the same and a larger code than the pivot's are parts of their own, and the same code is a node.
    """
    nodes: list[list] = []
    above: list[int] = []

    def node(members: list[int], at: int, parent: int) -> int:
        first = min(least[m] for m in members)
        n = sum(counts[m] for m in members)
        end = next((ends[m] for m in members if len(codes[m]) == at), EMPTY)
        nodes.append([first, at, nodes[parent][0] if parent >= 0 else top, n, 0, 0, (n - 1) * int(words[members[0]][at - 1]), end])
        above.append(parent)
        return len(nodes) - 1

    members = list(range(len(codes)))
    parts = [(members, depth + 1, node(members, depth + 1, -1))]
    while parts:
        members, at, parent = parts.pop()
        members = [m for m in members if len(codes[m]) > at]
        if not members:
            continue
        pivot = codes[members[len(members) // 2]][at]
        same = [m for m in members if codes[m][at] == pivot]
        if len(same) < len(members):
            parts.append(([m for m in members if codes[m][at] < pivot], at, parent))
            parts.append(([m for m in members if codes[m][at] > pivot], at, parent))
        parts.append((same, at + 1, node(same, at + 1, parent)))
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        own = nodes[i]
        own[5] = own[5] or 1
        if above[i] >= 0:
            parent = nodes[above[i]]
            parent[4] += 1
            parent[5] += own[5]
            parent[6] += own[6]
    return nodes


def _finished(rows: DataFrame) -> DataFrame:
    """The nodes of local buckets, with the bucket of those right below it: rows of a bucket and next code come together, in order, a bucket at a time."""

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def done() -> list[list]:
            nodes = multikey_nodes(*map(list, zip(*held)), key[2], key[0]) if held else []
            return [[*n, key[0] if n[1] == key[2] + 1 else None] for n in nodes]

        for batch in batches:
            out = []
            fields = zip(*(batch[c].tolist() for c in ("bucket", "code", "depth", "codes", "words", "n", "least", "ends")))
            for bucket, code, depth, codes, words, n, least, ends in fields:
                if key != (bucket, code, depth):
                    out += done()
                    key, held = (bucket, code, depth), []
                held.append((codes.tolist(), words, n, least, ends))
            yield pd.DataFrame(out, columns=[*COLUMNS, "bucket"])
        yield pd.DataFrame(done(), columns=[*COLUMNS, "bucket"])

    return rows.repartition("bucket", "code").sortWithinPartitions("bucket", "code").mapInPandas(finish, f"{NODE}, bucket long")


def _shared(lo: str, hi: str):
    """The number of first elements that two arrays share."""
    differ = F.array_position(F.zip_with(lo, hi, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(lo)).cast("int")


def trie(sequences: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """A row a node of the trie of (conv_id, codes, words), as NODE has it.

    A node is a sequence of first codes; its members are the conversations that start with it, also those
    without turns (of the root, at depth 0). ``conv_id`` is the least member; ``parent_conv_id`` is NULL for
    the root; ``saved_tokens`` adds up, over the subtree, the words of each node's last turn times its members
    but one; ``ends_sha256`` is of the members that end there. Identifiers must be different and not NULL;
    without rows there is no root. Each round is written to the shared folder, and the driver reads one row.
    """
    spark = sequences.sparkSession
    classes = written(classes_of(sequences), "classes")
    root = classes.agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.size("codes") == 0, F.col("ends"))).alias("ends")).first()
    if root["conv_id"] is None:
        return spark.createDataFrame([], NODE)
    live, live_at = classes.select(F.lit(root["conv_id"]).alias("bucket"), F.lit(0).alias("depth"), "*"), None
    finished, chains = [], []
    while True:
        dealt = live.where(F.size("codes") > F.col("depth")).withColumn("code", F.get("codes", F.col("depth")))
        children = dealt.groupBy("bucket", "depth", "code").agg(
            F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.size("codes") - F.col("depth")).alias("turns"), F.count(F.lit(1)).alias("rows"),
            F.min(F.struct("codes", "words", "ends")).alias("lo"), F.max("codes").alias("hi"),
        )
        children = written(children.withColumn("local", (F.col("turns") <= local_turns) | (F.col("rows") == 1)), "children")
        keys = children.select("bucket", "code", "local", "conv_id", _shared("lo.codes", "hi").alias("shared"))
        small = dealt.join(keys.where("local").select("bucket", "code"), ["bucket", "code"])
        finished.append(written(_finished(small.select("bucket", "code", "depth", "codes", "words", "n", "least", "ends")), "nodes"))
        large = children.where("NOT local").withColumn("shared", _shared("lo.codes", "hi"))
        chains.append(large.select(
            "bucket", "depth", "conv_id", "shared", "n_convs", F.slice("lo.words", F.col("depth") + 1, F.col("shared") - F.col("depth")).alias("words"),
            F.when(F.size("lo.codes") == F.col("shared"), F.col("lo.ends")).alias("ends"),
        ))
        if chains[-1].isEmpty():
            break
        further = dealt.join(keys.where("NOT local").select("bucket", "code", "conv_id", "shared"), ["bucket", "code"])
        before_at = live_at
        live, live_at = written_at(further.select(F.col("conv_id").alias("bucket"), F.col("shared").alias("depth"), "least", "n", "codes", "words", "ends"), "live")
        if before_at:
            remove(spark, before_at)

    totals = _totals(finished[-1])
    upper = []
    for nodes, chain in zip(finished[-2::-1], chains[-2::-1]):
        carried = written(chain.join(totals, chain["conv_id"] == totals["of"]).drop("of"), "upper")
        upper.append(_chain_nodes(carried))
        words = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w)
        totals = _totals(nodes, carried.select("bucket", "n_leaves", (F.col("saved_tokens") + (F.col("n_convs") - 1) * words).alias("saved_tokens")))
    top = spark.createDataFrame([(root["conv_id"], 0, None, root["n_convs"], root["ends"] or EMPTY)], "conv_id long, depth long, parent_conv_id long, n_convs long, ends_sha256 string")
    zero = F.lit(0).cast("long")
    counted = top.join(totals, top["conv_id"] == totals["of"], "left").withColumns(
        {"n_children": F.coalesce("n_children", zero), "n_leaves": F.coalesce("n_leaves", zero + 1), "saved_tokens": F.coalesce("saved_tokens", zero)}
    )
    return reduce(DataFrame.unionByName, [x.select(COLUMNS) for x in [counted, *upper, *finished]])


def _totals(nodes: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """(of, n_children, n_leaves, saved_tokens): what the nodes right below each bucket add up to."""
    own = nodes.where("bucket IS NOT NULL").select("bucket", "n_leaves", "saved_tokens")
    return (own if tops is None else own.unionByName(tops)).groupBy(F.col("bucket").alias("of")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )


def _chain_nodes(carried: DataFrame) -> DataFrame:
    """The nodes along what a large bucket's sequences share: each but the last has one child."""
    each = carried.select("*", F.posexplode("words").alias("i", "last_words")).withColumn("depth", (F.col("depth") + F.col("i") + 1).cast("long"))
    last = F.col("depth") == F.col("shared")
    from_here = F.sum("last_words").over(Window.partitionBy("conv_id", "shared").orderBy(F.desc("depth")))
    return each.select(
        "conv_id", "depth", F.when(F.col("i") == 0, F.col("bucket")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * from_here).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(EMPTY)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(encode(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), told AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS base,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 4 AS h
  FROM own
), rebuilt AS MATERIALIZED (
  SELECT t.conv_id, coalesce(b.turns[1 : t.h], []) || t.turns[t.h + 1 :] AS turns FROM told t LEFT JOIN own b ON b.conv_id = t.base
), steps AS (
  SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt
), nodes AS MATERIALIZED (
  SELECT depth, turns[1 : depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '') AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(turns[1 : depth][-1].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM steps GROUP BY depth, path
), childless AS (
  SELECT n.depth, n.path, count(c.conv_id) AS n_children FROM nodes n LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.path[1 : n.depth] = n.path GROUP BY n.depth, n.path
), spread AS (
  SELECT unnest(range(n.depth + 1)) AS depth, n.path AS whole, (n.n_convs - 1) * n.words AS saved, (c.n_children = 0)::BIGINT AS leaf
  FROM nodes n JOIN childless c USING (depth, path)
), summed AS (
  SELECT depth, whole[1 : depth] AS path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM spread GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, c.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN childless c USING (depth, path) JOIN summed s USING (depth, path) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1 : n.depth - 1]
"""
