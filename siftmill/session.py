"""Session construction and the settings every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results, as opposed to speed.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches; a cluster submits with its own settings."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **SEMANTICS,
        **extra,
    }
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()
