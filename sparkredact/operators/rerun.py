"""A changed document type runs the roles again, for the changed documents only.

Results are a table partitioned by a bucket of the document's id.  A rerun reads
the buckets that hold a changed document, takes the other documents' rows as
they are, and overwrites just those partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..session import materialize

BUCKET = "doc_bucket"


def write_results(results: DataFrame, path: str, buckets: int) -> None:
    """``results`` (doc_id, document_type, detected_type, ...) as Parquet, a partition a bucket of doc_id."""
    rows = results.withColumn(BUCKET, F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    rows.repartition(BUCKET, "doc_id").write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def changed_documents(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides`` (doc_id, document_type), one a document, under which the
    results would hold another type; null and unknown types ask for the detected
    one.  A document without results, or under that type already, needs no rerun."""
    wanted = overrides.select("doc_id", F.when(F.col("document_type").isin(vocab.DOC_TYPES), F.col("document_type")).alias("override"))
    held = results.select("doc_id", "document_type", "detected_type").distinct()
    return held.join(wanted, "doc_id").where(~F.col("document_type").eqNullSafe(F.coalesce("override", "detected_type"))).select("doc_id", "override")


def rerun(spark: SparkSession, path: str, buckets: int, overrides: DataFrame, run: Callable[[DataFrame], DataFrame]) -> int:
    """Bring the table at ``path`` up to ``overrides``; the number of documents run again.

    ``run`` gets the changed documents (doc_id, override) and returns their new
    rows, in the table's columns.  The new partitions are written aside first: a
    run that is lost half way leaves the table as it was, and the same call again
    finds what is left to do."""
    held = spark.read.parquet(path)
    changed = materialize(spark, changed_documents(held, overrides), "changed-types").withColumn(BUCKET, F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    n = changed.count()
    if not n:
        return 0
    touched = [r[0] for r in changed.select(BUCKET).distinct().collect()]  # at most ``buckets``
    others = held.where(F.col(BUCKET).isin(touched)).join(changed.select("doc_id"), "doc_id", "left_anti").select(*held.columns)
    again = run(changed.drop(BUCKET)).withColumn(BUCKET, F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).select(*held.columns)
    fresh = materialize(spark, others.unionByName(again), "rerun")
    fresh.repartition(BUCKET, "doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return n
