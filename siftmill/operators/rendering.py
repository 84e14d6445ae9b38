"""Rows rendered as short texts: labels, digests, outcomes of tool calls, and token-hash vectors."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.functions.batches import parts
from siftmill.sources.tables import written

# Sizes of digests and receipts, and the words for the outcomes of calls.
DIGEST_LINES, DIGEST_CHARS, RECEIPT_CHARS = 3, 600, 200
OUTCOMES = {"success": "succeeded", "failure": "failed", "rejected": "refused", "rate_limited": "refused (limit)"}


def source_label(source: Column, heading: Column, page: Column) -> Column:
    """``file § heading (p.N)``, without an empty heading or a page below 1; a NULL file is "unknown"."""
    return F.concat(
        F.coalesce(source, F.lit("unknown")),
        F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" § "), heading)).otherwise(""),
        F.when(page > 0, F.concat(F.lit(" (p."), page.cast("string"), F.lit(")"))).otherwise(""),
    )


def one_line_cut(text: Column, size: int) -> Column:
    """White space runs as one space; past ``size`` characters the start and an ellipsis."""
    line = T.normalize_ws(text)
    return F.when(F.char_length(line) <= size, line).otherwise(F.concat(F.substr(line, F.lit(1), F.lit(size - 1)), F.lit("…")))


def transcript_digest(lines: Column, count: int = DIGEST_LINES, size: int = DIGEST_CHARS) -> Column:
    """The last ``count`` lines, each on one line and with an equal share of ``size``; empty without lines."""
    last = F.slice(lines, F.greatest(F.size(lines) - count + 1, F.lit(1)), F.lit(count))
    n = F.greatest(F.size(last), F.lit(1))
    share = F.floor((F.lit(size) - (n - 1)) / n).cast("int")

    def cut(line: Column) -> Column:
        flat = T.normalize_ws(line)
        return F.when(F.char_length(flat) <= share, flat).otherwise(F.concat(F.substr(flat, F.lit(1), share - 1), F.lit("…")))

    return F.array_join(F.transform(last, cut), "\n")


def tool_outcomes(calls: DataFrame, by: list[str], seq_col: str = "seq", tool_col: str = "tool", status_col: str = "status", path_col: str | None = None) -> DataFrame:
    """(by..., outcomes): each different outcome of a group's calls once, in the order first seen.

    An outcome is the tool, its path in backquotes where ``path_col`` has one, and the word for the status
    (an unknown one as it is); ``x n`` follows where it repeats. Calls are first counted by outcome, so a
    group reaches one task as one row an outcome. NULL tools and statuses count as empty.
    """
    words = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    status = F.coalesce(F.col(status_col), F.lit(""))
    path = F.lit("") if path_col is None else F.when(F.col(path_col).isNotNull(), F.concat(F.lit(" `"), F.col(path_col), F.lit("`"))).otherwise("")
    label = F.concat(F.coalesce(F.col(tool_col), F.lit("")), path, F.lit(" "), F.coalesce(F.try_element_at(words, status), status))
    counted = calls.groupBy(*by, label.alias("_label")).agg(F.count(F.lit(1)).alias("_n"), F.min(seq_col).alias("_first"))
    shown = F.when(F.col("_n") > 1, F.concat("_label", F.lit(" x"), F.col("_n").cast("string"))).otherwise(F.col("_label"))
    ordered = F.array_sort(F.collect_list(F.struct("_first", "_label", shown.alias("shown"))))
    return counted.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), "; ").alias("outcomes"))


def token_position(token: Column, dim: int) -> Column:
    """The MD5 of a token, read as one number, modulo ``dim``: folded over its eight 16-bit parts."""
    digest = F.md5(token)
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: (acc * 65536 + x) % dim)


def token_hash_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = 256) -> DataFrame:
    """(id, position, value): the places that are not zero of each text's unit vector of hashed words.

    The vector of a text stands in for an embedding model's: it counts the words at their positions and has
    length 1. NULL texts and texts without words have no rows. Rows that share an identifier count as one
    text; NULL identifiers too. Words are counted in their row; only the places of repeated identifiers are shuffled.
    """
    own = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    twice = written(own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "twice")
    repeated = F.col("id").eqNullSafe(F.col("_id"))
    twice = twice.select(F.col("id").alias("_id"))
    once = _places(own.join(twice, repeated, "left_anti"), dim)
    # at most dim places an identifier
    gathered = _places(own.join(twice, repeated, "left_semi"), dim).select("id", F.explode("places").alias("place")).groupBy("id", "place.position").agg(F.sum("place.n").alias("n"))
    vectors = once.union(gathered.groupBy("id").agg(F.collect_list(F.struct("position", "n")).alias("places")))
    length = F.sqrt(F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["n"] * p["n"]).cast("double"))
    return vectors.select(F.col("id").alias(id_col), F.explode("places").alias("place"), length.alias("length")).select(
        id_col, "place.position", (F.col("place.n") / F.col("length")).alias("value")
    )


def _places(rows: DataFrame, dim: int) -> DataFrame:
    """(id, places) of (id, text), lower-cased: how often each row's words are at each of their positions."""
    word, kind = re.compile(T.WORD), dict(rows.dtypes)["id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = lru_cache(1 << 16)(lambda w: int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest(), "big") % dim)
        for batch in (part for whole in batches for part in parts(whole, "text")):
            at, n, ends = [], [], [0]
            for text in batch.column("text").to_pylist():
                own = Counter()
                for w, times in Counter(word.findall(text or "")).items():
                    own[position(w)] += times
                at += own.keys()
                n += own.values()
                ends.append(len(at))
            pairs = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["position", "n"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["id", "places"])

    return rows.mapInArrow(count, f"id {kind}, places array<struct<position: long, n: long>>")
