"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected target / source_size times. The running sum of these expected copies
along the source, started at one random offset, emits a document once for every integer it crosses. The
order along a source runs by size class, so the words taken come out near the target and not just the
number of documents. The running sum never needs a source in one task: it is put together from counts of
(source, size class) and (source, size class, slice), and only a slice is numbered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.storage import documents, word_count, written

#: A document is taken at most this many times; a source's target is at most this many times its size.
CAP = 3
#: Slices of a size class: the most even split of a source that is all one size. There are twice as many
#: for each doubling of the rows beyond SLICE_ROWS a slice.
SLICES, SLICE_ROWS = 256, 100_000


def _size_class(size: Column) -> Column:
    """Number of bits of the size and its next two bits: classes of at most a quarter's spread."""
    bits = F.char_length(F.bin(size))
    return (bits * 4 + F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0))).bitwiseAND(F.lit(3))).cast("int")


def _slice(id_text: Column, slices: int) -> Column:
    return (F.conv(F.substring(F.md5(id_text), 1, 8), 16, 10).cast("long") % slices).cast("int")


def source_targets(sizes: DataFrame, cap: int = CAP, cycle: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Weights are 1 to ``cycle``, repeating, by the code points of the source, NULL last. A target is
    weight x L, or ``cap`` times the source's size if that is less, with L such that the targets add up to
    all sizes: what resharing the excess until no source is above its cap comes to. The windows here run
    over one row a source.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % cycle + 1)
    by_ratio = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("source_size") * cap)
        .withColumn("chosen", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    )
    wanted = F.col("chosen") * F.col("weight")
    return level.select(
        "source", "source_size",
        F.when(wanted > F.col("source_size") * cap, (F.col("source_size") * cap).cast("double")).otherwise(wanted).alias("target"),
    )


def offset_of(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): the same on every run."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def systematic_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, cap: int = CAP, slices: int | None = None, carry: bool = False) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row, and with ``carry`` the row itself as struct ``row``.

    Size is the number of words; NULL and empty texts have size 0 and take nothing whatever their copies.
    A NULL source is a source of its own; NULL identifiers and repeated rows are numbered like other rows
    (rows equal in identifier and size swap places without effect). A source without words has target 0.
    An empty table gives an empty result. Columns of other names are not read unless carried. Carried rows
    without an identifier are dealt, and rows of equal identifier and size ordered, by a hash of their text.
    """
    carried = [F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(text_col)).alias("tie")] if carry else []
    kept, ties = (["row"], ["tie"]) if carry else ([], [])
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *carried)
    if not carry:
        sized = written(sized, "sizes")  # three readers, and counting the words is all the work
    slices = slices or SLICES << max(0, (sized.count() - 1) // (SLICES * SLICE_ROWS)).bit_length()
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
    id_text = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null"), *ties))
    keyed = sized.select("id", "source", "size", _size_class(F.col("size")).alias("class"), _slice(id_text, slices).alias("slice"), *kept, *ties)

    # rows before a slice: of the classes before it in the source, and of the slices before it in the class
    cells = keyed.groupBy("source", "class", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    classes = classes.select("source", "class", before(Window.partitionBy("source").orderBy("class")).alias("class_start"))
    starts = cells.select("source", "class", "slice", before(Window.partitionBy("source", "class").orderBy("slice")).alias("slice_start"))
    per_source = targets.select("source", "source_size", "target")
    same = lambda a, b, *on: [a["source"].eqNullSafe(b["source"]), *[a[c] == b[c] for c in on]]
    starts = starts.join(classes, same(starts, classes, "class")).select(starts["source"], starts["class"], "slice", (F.col("class_start") + F.col("slice_start")).alias("start"))
    starts = starts.join(per_source, same(starts, per_source)).select(starts["source"], "class", "slice", "start", "source_size", "target")

    placed = keyed.join(starts, same(keyed, starts, "class", "slice")).select(keyed["*"], "start", "source_size", "target")
    within = Window.partitionBy("source", "class", "slice").orderBy("size", F.asc_nulls_last("id"), *ties)
    rank = F.col("start") + F.row_number().over(within)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = placed.select(
        "id", "size", "source_size", "target", *kept,
        (F.floor(offset_of(F.col("source"), seed) + expected * rank) - F.floor(offset_of(F.col("source"), seed) + expected * (rank - 1))).alias("copies"),
    )
    copies = F.least(F.col("copies"), F.lit(cap)).cast("long")
    return crossed.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *kept)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; no row is found again by its identifier.

    Rows that share an identifier, NULL or not, are numbered and taken each by itself.
    """
    copies = systematic_copies(docs, id_col, text_col, source_col, seed, carry=True).where("copies > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op5_systematic_mix(spark, sf_dir: str) -> DataFrame:
    mixed = systematic_copies(documents(spark, sf_dir, "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size,
    length(bin(size)) * 4 + ((size >> greatest(length(bin(size)) - 3, 0)) & 3) AS class,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % 256 AS slice FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left FROM w),
v AS (SELECT *, CAST(total - capped AS BIGINT) / CAST(weight_left AS BIGINT) AS level FROM l),
c AS (SELECT *, max(CASE WHEN level * weight <= source_size * 3 THEN level END) OVER () AS chosen FROM v),
t AS (SELECT source, source_size, CASE WHEN chosen * weight > source_size * 3 THEN CAST(source_size * 3 AS DOUBLE) ELSE chosen * weight END AS target,
    CAST('0x' || substr(md5(concat('17:', coalesce('s' || source, 'null'))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM c),
r AS (SELECT k.*, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, doc_id NULLS LAST) AS rank FROM k),
e AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.u, r.rank, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS p
    FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, least(CAST(floor(u + p * rank) - floor(u + p * (rank - 1)) AS BIGINT), 3) AS copies FROM e)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM f"""
