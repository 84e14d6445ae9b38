"""A guarded SQL query: one read-only statement with a bounded number of rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Default and greatest number of rows.
DEFAULT_ROWS, MOST_ROWS = 50, 200


def guarded_sql(spark: SparkSession, statement: str, max_rows: int = DEFAULT_ROWS) -> DataFrame:
    """The first ``max_rows`` rows (1 to 200) of one SELECT or WITH statement.

    A trailing semicolon is dropped; another one, or a statement that starts otherwise, raises ValueError.
    The statement runs as a subquery, where Spark's grammar has no room for commands or inserts.
    """
    own = statement.strip().rstrip(";").strip()
    if ";" in own:
        raise ValueError("one statement only")
    if not re.match(r"(?i)(select|with)\b", own):
        raise ValueError("only SELECT or WITH")
    if not 1 <= max_rows <= MOST_ROWS:
        raise ValueError(f"max_rows must be 1 to {MOST_ROWS}")
    return spark.sql(f"SELECT * FROM (\n{own}\n)").limit(max_rows)


def schema_description(spark: SparkSession, tables: tuple[str, ...]) -> str:
    """A line a table: its name and its columns with their types."""
    return "\n".join(f"{t}({', '.join(f'{f.name} {f.dataType.simpleString().upper()}' for f in spark.table(t).schema)})" for t in tables)
