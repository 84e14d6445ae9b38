"""Blocks of pages and recursive chunks of documents: no SQL, tested against hand-made cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import structure
from siftmill.sources.tables import read_table, spread


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.html_blocks(read_table(spark, sf_dir, "pages"))


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(structure.recursive_chunks(F.col("text"))).alias("ordinal", "chunk"))


QUERIES = {f.__name__: f for f in (html_blocks, recursive_chunks)}
ORACLES: dict[str, str] = {}
