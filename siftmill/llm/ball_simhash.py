"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant within r/2 of each, so every distinct fingerprint emits
all its variants within half the radius and those that meet on a variant are within r of each other:
a variant's fingerprints form a clique, and linking each to the least of them loses no connection.
For 64 bits and radius 2 a fingerprint emits 65 variants and a variant meets at most 65 fingerprints,
whatever the number of documents; copies of a text are one fingerprint before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.graph import connected_components
from siftmill.llm.storage import documents, written

BITS = 64
#: Hashes whose bits are counted at once; bounds the memory of a very long text.
BLOCK = 1 << 14


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned integer; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # for bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    span = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[span - 1 :])), np.uint64, len(words) - span + 1
    )
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK]
        counts += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def simhash(shingle: int = 3, seed: int = 42):
    """A column function: text to fingerprint, as a signed BIGINT of the same bits."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.LongType())


def ball(radius: int, bits: int = BITS) -> list[int]:
    """Masks of up to ``radius`` bits, as signed 64-bit integers."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links among distinct fingerprints (column ``fp``) that connect all within ``radius``.

    ``radius`` must be even: then those that share a variant are within it and only the least of a variant
    need be linked to the others. Each pair is deduplicated and verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    pairs = variants.select("fp", least.alias("low")).where("low <> fp").distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= radius).select(F.col("low").alias("a"), F.col("fp").alias("b"))


def fingerprint_components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of (id, fp): root is the component's own, component_id its least id."""
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(fingerprint_links(classes.select("fp"), radius))
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "least")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    moved = linked.join(lowest, "root").select("fp", "root", "lowest")
    return classes.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", "least").alias("component_id"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    NULL texts and texts without words have fingerprint zero and are linked like any other; texts of fewer
    words than a shingle hash as a whole; long texts are hashed whole. component_id is the least identifier
    reached over links of at most ``radius`` differing bits, itself included; NULL identifiers are never the
    least (a group of NULLs only has a NULL component). Repeated rows give repeated rows, an empty table an
    empty result. Other columns are not read.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), simhash(shingle, seed)(F.col(text_col)).alias("fp")), "simhash")
    # written, so that the last join deals both sides anew and a frequent fingerprint can be split
    component = written(fingerprint_components(prints, radius).select("fp", "component_id"), "components")
    return prints.join(component, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One document of each group, that of the least identifier; rows without an identifier stay.

    A row is known by identifier and text: rows of one identifier whose texts are in different groups are
    each judged in their own. Of a group's least identifier the text of the least digest stays, once.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = whole.withColumn("digest", F.coalesce(F.md5("text"), F.lit("")))
    prints = written(whole.select("id", "digest", simhash(shingle, seed)(F.col("text")).alias("fp")), "simhash")
    firsts = prints.where("id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("id", "digest")).alias("first"))
    stays = firsts.join(fingerprint_components(prints, radius), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    once = whole.join(stays, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    return once.select("row").union(whole.where("id IS NULL").select("row")).select("row.*")


def op10_ball_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir, "doc_id", "text"))
