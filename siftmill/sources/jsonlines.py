"""Files of JSON lines with the number of each line, whatever the splits they are read in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.sources.tables import written


def numbered_lines(spark: SparkSession, *paths: str, named: bool = False) -> DataFrame:
    """(path, line, text) of every line of the files, blank ones too, numbered from 1 in each file.

    Spark reads a large file in splits. Lines are numbered within their split; the lines of a file's earlier
    splits are added, which are one row a split, so no task reads a whole file. A split is as large as
    ``spark.sql.files.maxPartitionBytes`` lets it be. Files are opened once: what is read is kept as a table.

    With ``named`` a file holds many logs, as a log shipper packs them: each line begins with its log's name and
    a tab. The name is the ``path``, and lines are numbered within it; a log's lines stand in one file, in order,
    among other logs' lines or not.
    """
    text = F.col("value")
    name, rest = (F.substring_index(text, "\t", 1), F.expr("substring(value, instr(value, '\t') + 1)")) if named else (F.col("_metadata.file_path"), text)
    read = spark.read.text(list(paths)).select(
        name.alias("path"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), rest.alias("text")
    )
    read = written(read, "lines")
    splits = read.groupBy("path", "_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    earlier = Window.partitionBy("path").orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("path", "_file", "_start", "_first", (F.col("_last") - F.col("_first") + 1 == F.col("_n")).alias("_dense"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = read.join(placed, ["path", "_file", "_start"])
    # rows of a split are numbered one after another, as a split is read by one task and in order
    dense = joined.where("_dense").select("path", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line"), "text")
    if not named:
        return dense
    # a log among others' lines has gaps in its split
    within = F.row_number().over(Window.partitionBy("path", "_file", "_start").orderBy("_row"))
    return dense.unionByName(joined.where("NOT _dense").select("path", (F.col("_before") + within).alias("line"), "text"))


def records(lines: DataFrame) -> DataFrame:
    """(path, line, record, error) of the lines that aren't blank: a variant, or NULL and why there is none."""
    # an exploded record is parsed once; a plain column is parsed by each condition and column that reads it
    told = lines.where(F.regexp_like("text", F.lit(r"\S"))).select("path", "line", F.explode(F.array(F.try_parse_json("text"))).alias("record"))
    kind = F.schema_of_variant("record")
    error = F.when(F.col("record").isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "not a JSON object")
    return told.select("path", "line", F.when(error.isNull(), F.col("record")).alias("record"), error.alias("error"))


def latest_records(found: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The last record of each key of a file: ``keys`` names JSON paths and their types. Records without a key have NULL ones."""
    named = found.where("error IS NULL").select("path", "line", "record", *[F.try_variant_get("record", at, kind).alias(name) for name, (at, kind) in ((n, v.split(" ")) for n, v in keys.items())])
    last = named.groupBy("path", *keys).agg(F.max_by(F.struct("line", "record"), "line").alias("_last"))
    return last.select("path", *keys, "_last.line", "_last.record")


def findings(found: DataFrame, required: dict[str, str], id_path: str = "$.id") -> DataFrame:
    """(path, line, message) of records that can't be taken.

    A line that is no JSON object; a field of ``required`` (name to type: string, bigint, boolean, double, array
    or object) that is missing or of another type; an identifier that an earlier line of the file has, which is
    named. NULL identifiers aren't compared.
    """
    whole = found.where("error IS NULL")

    def rule(name: str, kind: str):
        value = F.try_variant_get("record", F.lit(f"$.{name}"), "variant")
        own = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        own = F.when(own.isin("DECIMAL", "DOUBLE", "FLOAT"), "DOUBLE").otherwise(own)
        return F.when(value.isNull(), f"{name} is missing").when((own != kind.upper()) & ~((F.lit(kind) == "double") & (own == "BIGINT")), f"{name} is not of type {kind}")

    messages = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array_compact(F.array(*[rule(n, k) for n, k in required.items()], F.lit(None).cast("string"))))
    ruled = found.select("path", "line", F.explode(messages).alias("message"))
    named = whole.select("path", "line", F.try_variant_get("record", id_path, "string").alias("id")).where("id IS NOT NULL")
    firsts = named.groupBy("path", "id").agg(F.min("line").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    twice = named.join(firsts, ["path", "id"]).where(F.col("line") > F.col("_first"))
    return ruled.unionByName(twice.select("path", "line", F.format_string("duplicate id (first on line %d)", "_first").alias("message")))
