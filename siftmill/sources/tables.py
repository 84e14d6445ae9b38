"""Readers for the Parquet tables of a dataset folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes the shuffle files of a finished query.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the dataset, by the path Spark resolves (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew where it is read from fewer files than there are cores, so that work on long texts
    isn't one task's; a table of many files, as any large one, is left as it is and not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views under the table names, for SQL text."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder; a cluster an error,
    as its executors would write to their own disks."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="siftmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/siftmill/{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """The rows of ``df``, written once as Parquet in the shared folder and read back, and their path.

    The write's own shuffle files go as soon as it ends: nothing reads them once the table is there, and
    the phases of an operator don't add up on the disks.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """As :func:`written_at`, without the path. It cuts the lineage: a lost executor costs no recomputing
    beyond this table, and a costly column is not computed by each of its readers."""
    return written_at(df, name, **options)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more, on whatever file system it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
