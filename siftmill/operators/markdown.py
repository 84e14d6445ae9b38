"""Sections of Markdown texts with their heading paths, and chunks cut out of sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators.structure import cut_hard, merged

#: Joins the headings of a path, and a path and its chunk.
PATH_JOINER, PREFIX_JOINER = " > ", "\n\n"
#: A list of attributes at the end of a heading, which names an anchor or a class.
ATTRIBUTES = r"\s*\{\s*[#.][^{}]*\}\s*$"

_SECTION = "struct<heading: string, path: array<string>, text: string>"
_OPEN = "array<struct<level: int, title: string>>"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sections(text: Column) -> Column:
    """array<struct<heading, path, text>>: the blocks of a Markdown text, in order.

    A line that starts with ``#`` after blanks is a heading unless a fence of backticks or tildes is open;
    no space need follow. ``path`` has the heading of each level above and the heading itself, without
    lists of attributes. A heading without a title ends a block and keeps the heading before it. Blocks
    without text are left out; a text without any gives one empty block. NULL stays NULL.
    """
    start = F.struct(
        F.lit(False).alias("fenced"), F.lit(None).cast("string").alias("heading"), F.array().cast(_OPEN).alias("open"),
        F.array().cast("array<string>").alias("lines"), F.array().cast(f"array<{_SECTION}>").alias("out"),
    )

    def section(acc: Column, body: Column) -> Column:
        return F.struct(acc["heading"].alias("heading"), F.transform(acc["open"], lambda h: h["title"]).alias("path"), body.alias("text"))

    def flushed(acc: Column) -> Column:
        body = _strip(F.array_join(acc["lines"], "\n"))
        return F.when(body == "", acc["out"]).otherwise(F.array_append(acc["out"], section(acc, body)))

    def step(acc: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+", "")
        fence = bare.startswith("```") | bare.startswith("~~~")
        heading = ~fence & ~acc["fenced"] & bare.startswith("#")
        level = F.char_length(F.regexp_extract(bare, "^(#*)", 1))
        title = _strip(F.regexp_replace(bare, "^#+", ""))
        shown = F.regexp_replace(title, ATTRIBUTES, "")
        entered = F.struct(level.alias("level"), F.when(shown == "", title).otherwise(shown).alias("title"))
        titled = heading & (title != "")
        return F.struct(
            (acc["fenced"] != fence).alias("fenced"),
            F.when(titled, title).otherwise(acc["heading"]).alias("heading"),
            F.when(titled, F.array_append(F.filter(acc["open"], lambda h: h["level"] < level), entered)).otherwise(acc["open"]).alias("open"),
            F.when(heading, F.array().cast("array<string>")).otherwise(F.array_append(acc["lines"], line)).alias("lines"),
            F.when(heading, flushed(acc)).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        out = flushed(acc)
        return F.when(F.size(out) == 0, F.array(section(acc, F.lit("")))).otherwise(out)

    return F.aggregate(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), start, step, finish)


def with_heading_path(path: Column, piece: Column) -> Column:
    """``A > B``, an empty line and the piece; the piece alone without a path."""
    return F.when(F.coalesce(F.size(path), F.lit(0)) <= 0, piece).otherwise(F.concat(F.array_join(path, PATH_JOINER), F.lit(PREFIX_JOINER), piece))


def section_chunks(
    docs: DataFrame, split: Callable[[Column], Column], strategy: str, id_col: str = "doc_id", text_col: str = "text", paths: bool = False,
) -> DataFrame:
    """(id, ordinal, heading, chunk, chunk_id) of each section's chunks; ``split`` maps a text to an array.

    Ordinals run over all sections of a document. ``paths`` puts the heading path in front of each chunk,
    after splitting. NULL texts give nothing; repeated rows are numbered each by themselves. Nothing is
    shuffled: a document's pieces are flattened within its row.
    """
    found = F.transform(sections(F.col(text_col)), lambda s: F.transform(
        split(s["text"]),
        lambda piece: F.struct(s["heading"].alias("heading"), (with_heading_path(s["path"], piece) if paths else piece).alias("chunk")),
    ))
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.flatten(found)).alias("ordinal", "piece"))
    rows = rows.select("id", "ordinal", "piece.heading", "piece.chunk")
    key = T.chunk_id(F.col("id").cast("string"), F.lit(strategy), F.col("ordinal"), F.col("heading"), F.lit(None), F.col("chunk"))
    return rows.withColumn("chunk_id", key).withColumnRenamed("id", id_col)


def semantic_chunks(
    sentences: DataFrame, group_col: str, order_col: str, text_col: str, vector_col: str, least_cosine: float = 0.5, size: int = 800,
) -> DataFrame:
    """(group, ordinal, chunk): runs of sentences whose neighbours are alike, merged up to ``size``.

    A run ends before a sentence whose vector has a cosine under ``least_cosine`` with the one before it (a
    zero or NULL vector has cosine 0 with any). Each run is joined by spaces; neighbouring runs are merged
    by empty lines while they fit; longer ones are cut hard. A text that fits ``size`` whole is one chunk.
    NULL and empty sentences are left out. A group is one text: its sentences meet in one task, as its
    characters do anyway.
    """
    rows = sentences.select(
        F.col(group_col).alias("group"), F.col(order_col).alias("at"), F.col(text_col).alias("text"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where("text IS NOT NULL AND text <> ''")
    by = Window.partitionBy("group").orderBy("at", "text")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    before, now = F.col("before"), F.col("vector")
    cosine = F.coalesce(F.try_divide(dot(before, now), F.sqrt(dot(before, before)) * F.sqrt(dot(now, now))), F.lit(0.0))
    placed = rows.select("*", F.lag("vector").over(by).alias("before"), F.row_number().over(by).alias("place"))
    broken = placed.withColumn("break", ((F.col("place") > 1) & (cosine < least_cosine)).cast("int"))
    runs = broken.select("group", "place", "text", F.sum("break").over(by).alias("run"))
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c, "text")))
    joined = runs.groupBy("group", "run").agg(F.array_join(F.transform(ordered("place"), lambda s: s["text"]), " ").alias("text"))
    texts = joined.groupBy("group").agg(F.transform(ordered("run"), lambda r: r["text"]).alias("runs"))
    whole = F.array_join("runs", " ")
    pieces = F.when(F.char_length(whole) <= size, F.array(whole)).otherwise(F.flatten(F.transform(merged(F.col("runs"), size, "\n\n"), lambda p: cut_hard(p, size))))
    return texts.select(F.col("group").alias(group_col), F.posexplode(pieces).alias("ordinal", "chunk"))
