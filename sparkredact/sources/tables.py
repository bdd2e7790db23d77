"""Readers for the corpus tables, with column names normalised for the library.

Library-wide document schema: ``doc_id, content, language`` (+ any extras).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Text work is CPU-bound per row.  When a scan yields fewer splits than
    the cluster has cores (a few large row groups), spread rows round-robin;
    at cluster scale the scan already has thousands of splits and this is a
    no-op (the partition count is known from the plan, no job runs)."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


# Documents that one task works on; a task's time is this many documents, however many there are.
DOCS_PER_TASK = 5_000


def partitions_for(df: DataFrame, per_task: int | None = None) -> int:
    """Partitions for work on every row of ``df``: the session's shuffle partitions,
    or more once a partition would have more than ``per_task`` rows (``DOCS_PER_TASK``).
    The rows of a Parquet table are counted from its footers."""
    rows, per_task = df.count(), per_task or DOCS_PER_TASK
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as ``doc_id, content, language, source, n_chars``."""
    return (table(spark, sf_dir, "documents")
            .select("doc_id", F.col("text").alias("content"), F.col("lang").alias("language"),
                    "source", "n_chars"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "doc_id", path: str | None = None) -> None:
    """Write a table bucketed and sorted by ``key`` (default ``doc_id``).

    Write documents, model outputs and entity tables with the same bucket
    count and the ``doc_id`` joins between them (merge, legal context,
    institutions, proximity, substitution) plan without an Exchange on
    either side -- the text column is never shuffled."""
    w = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
