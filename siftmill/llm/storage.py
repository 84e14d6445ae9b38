"""Input helpers, and the written tables of :mod:`siftmill.sources.tables` under one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.sources.tables import new_path, remove, shared_dir, written, written_at

__all__ = ["ascii_lower", "documents", "new_path", "remove", "shared_dir", "word_count", "written", "written_at"]

#: Words in the sense of the contracts: maximal runs of anything but space and the controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Where every character takes one byte, that is lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
