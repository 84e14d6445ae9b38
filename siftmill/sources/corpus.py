"""Files of a folder as documents of blocks, their fingerprint, and documents written as JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import markdown, structure

# The kinds of files by the end of their names.
KINDS = {"txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html"}
BLOCK = "array<struct<heading: string, path: array<string>, text: string>>"


def kind_of(path: Column) -> Column:
    """text, markdown or html by the suffix, whatever its case; NULL for another one."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), suffix)


def glob_pattern(glob: str) -> str:
    """A regular expression: ``**/`` is any number of folders, ``*`` and ``?`` stay within one."""
    parts = re.split(r"(\*\*/|\*|\?)", glob)
    return "^" + "".join({"**/": "(?:[^/]+/)*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def selected(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether a path fits one of ``include`` and none of ``exclude``."""
    fits = lambda globs: F.lit(False) if not globs else F.regexp_like(path, F.lit("|".join(map(glob_pattern, globs))))
    return fits(list(include)) & ~fits(list(exclude))


def drop_lines(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """The text without lines that any pattern matches somewhere, and the number of lines dropped."""
    any_of = F.lit("|".join(f"(?:{p})" for p in patterns))
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda line: ~F.regexp_like(line, any_of))
    return F.array_join(kept, "\n"), F.size(lines) - F.size(kept)


def read_files(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """(source_file, content) of the files below a folder whose kind is known; others are passed over.

    source_file is the path within the folder. A file is one row, read whole by one task. Spark's reader has no
    row for an empty file, so these are added from its list of paths, with empty content.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    listed = spark.createDataFrame([(re.sub(r"^(\w+):///", r"\1:/", p),) for p in read.inputFiles()], "listed string")
    exact = F.url_decode(F.regexp_replace("listed", r"\+", "%2B"))
    empty = listed.join(read.select(F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("_path")), exact == F.col("_path"), "left_anti")
    files = read.union(empty.select("listed", F.lit(b"").alias("content")))
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    own = files.select(F.expr("substring_index(path, '#', 1)").alias("path"), "content")
    named = own.select(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^" + re.escape(base), "").alias("source_file"), "content")
    known = named.where(kind_of(F.col("source_file")).isNotNull())
    return known.where(selected(F.col("source_file"), include, list(exclude))) if include else known


def documents(files: DataFrame) -> DataFrame:
    """(source_file, doc_type, blocks) of each file: normalised blocks in order, empty ones left out.

    A file of a kind that isn't known raises an error; a text file is one block.
    """
    kind = F.coalesce(kind_of(F.col("source_file")), F.raise_error(F.concat(F.lit("unsupported file: "), F.col("source_file"))).cast("string"))
    own = files.select("source_file", kind.alias("doc_type"), F.decode("content", "UTF-8").alias("text"))
    plain = own.where("doc_type = 'text'").select("source_file", "doc_type", F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("path"), "text")).cast(BLOCK).alias("blocks"))
    marked = own.where("doc_type = 'markdown'").select("source_file", "doc_type", markdown.sections(F.col("text")).cast(BLOCK).alias("blocks"))
    pages = structure.html_blocks(own.where("doc_type = 'html'"), "source_file", "text").groupBy("source_file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "heading", "path", "text"))), lambda b: F.struct(b["heading"].alias("heading"), b["path"].alias("path"), b["text"].alias("text"))).cast(BLOCK).alias("blocks")
    )
    return plain.union(marked).union(pages.select("source_file", F.lit("html").alias("doc_type"), "blocks")).withColumn("blocks", normalized(F.col("blocks")))


def normalized(blocks: Column) -> Column:
    """Blocks with normalised texts, without those that are then empty."""
    clean = F.transform(blocks, lambda b: b.withField("text", T.normalize_text(b["text"])))
    return F.filter(clean, lambda b: b["text"] != "")


def document_chunks(docs: DataFrame, split, strategy: str, paths: bool = False) -> DataFrame:
    """(source_file, ordinal, heading, text, chunk_id): the pieces of all blocks of each document, numbered through."""
    found = F.transform("blocks", lambda b: F.transform(split(b["text"]), lambda piece: F.struct(
        b["heading"].alias("heading"), (markdown.with_heading_path(b["path"], piece) if paths else piece).alias("text"))))
    rows = docs.select("source_file", F.posexplode(F.flatten(found)).alias("ordinal", "piece")).select("source_file", "ordinal", "piece.*")
    return rows.withColumn("chunk_id", T.chunk_id(F.col("source_file"), F.lit(strategy), F.col("ordinal"), F.col("heading"), F.lit(None), F.col("text")))


def fingerprint(files: DataFrame, path: str = "source_file", content: str = "content") -> DataFrame:
    """One row: SHA-256 of the lines path, tab, SHA-256 of the bytes, sorted by path. A line a file meets in one task."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))))
    text = F.array_join(F.transform(lines, lambda r: F.concat(r["path"], F.lit("\t"), r["digest"], F.lit("\n"))), "")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(text.cast("binary"), 256).alias("digest"))


def write_documents(docs: DataFrame, folder: str) -> None:
    """A folder a document, named after it with ``__`` for ``/``, holding its JSON."""
    named = docs.withColumn("name", F.replace("source_file", F.lit("/"), F.lit("__")))
    named.repartition("name").write.mode("overwrite").partitionBy("name").json(folder)
