"""File sources and sinks.

All readers declare their schema (no inference) and all sinks are
DataFrame writers; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab

ENTITY_ITEM = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("entity_type", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()), T.StructField("semantic_role", T.StringType()),
    T.StructField("proposed_replacement", T.StringType())])
MAPPING_ITEM = T.StructType([
    T.StructField("original", T.StringType()), T.StructField("replacement", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("entity_type", T.StringType()),
    T.StructField("semantic_role", T.StringType())])
GROUND_TRUTH_SCHEMA = T.StructType([
    T.StructField("document", T.StringType()),
    T.StructField("entities", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("category", T.StringType()),
        T.StructField("entity_type", T.StringType())])))])
RUN_RECORD_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("document", T.StringType()), T.StructField("document_id", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("char_count", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("extraction", T.StructType([
        T.StructField("entities_count", T.LongType()), T.StructField("processing_time_ms", T.LongType()),
        T.StructField("categories_requested", T.ArrayType(T.StringType())),
        T.StructField("entities", T.ArrayType(ENTITY_ITEM))])),
    T.StructField("anonymization", T.StructType([
        T.StructField("mappings_count", T.LongType()), T.StructField("processing_time_ms", T.LongType()),
        T.StructField("mappings", T.ArrayType(MAPPING_ITEM)),
        T.StructField("anonymized_preview", T.StringType())])),
    T.StructField("error", T.StringType())])


def read_text_corpus(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """A1 + A2 + A4: one document per ``.md``/``.txt`` file (whole file, UTF-8),
    optional file-name prefix filter, in file-name order."""
    df = (spark.read.option("wholetext", "true").text(path)
          .select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content")))
    ext = F.lower(F.regexp_extract("filename", r"(\.[^./]+)$", 1))
    df = df.where(ext.isin(vocab.PLAIN_TEXT_EXTENSIONS))
    if prefix:
        df = df.where(F.col("filename").startswith(prefix))
    return df.withColumn("doc_id", F.sha2(F.col("filename"), 256)).orderBy("filename")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files -> (document, value, category, entity_type).  A file
    with an empty list is one row of nulls: the document is annotated and all it
    predicts is false.  Only a document without a file has no row."""
    gt = spark.read.schema(GROUND_TRUTH_SCHEMA).option("multiLine", "true").json(path)
    return gt.select("document", F.explode_outer("entities").alias("e")).select("document", "e.value", "e.category", "e.entity_type")


SUMMARY_SUFFIX = "_SUMMARY.json"


def latest_run(spark: SparkSession, path: str) -> str | None:
    """The stamp of the summary file that is last by name; none without a summary."""
    names = (spark.read.option("wholetext", "true").option("pathGlobFilter", f"*{SUMMARY_SUFFIX}").text(path)
             .select(F.col("_metadata.file_name").alias("name")))
    last = names.agg(F.max("name")).first()[0]
    return last[:-len(SUMMARY_SUFFIX)] if last else None


def read_run_records(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The per-document records of one run, the files named ``{run}_*.json``
    but for its summary; by default those of the latest run.  No run, no rows."""
    run = run or latest_run(spark, path)
    recs = (spark.read.schema(RUN_RECORD_SCHEMA).option("multiLine", "true")
            .option("pathGlobFilter", f"{run}_*.json" if run else f"*{SUMMARY_SUFFIX}").json(path))
    return recs.where(~F.col("_metadata.file_name").endswith(SUMMARY_SUFFIX))


def run_id_of(ts) -> "F.Column":
    """Run id ``yyyyMMdd'T'HHmmss'Z'`` from a UTC timestamp column."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def write_run(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """The results or the report of one run, under ``run_id=...``.

    Written again, a run replaces its own rows and no other run's.  A report that
    is sorted keeps its order over the part files, in the order of their names."""
    df = df.drop("run_id").withColumn("run_id", F.lit(run_id))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").format(fmt).save(path)


def write_redacted_text(df: DataFrame, path: str, col: str = "anonymized", id_col: str = "doc_id") -> None:
    """A10: redacted text, a JSON object per document with its id, so that texts
    of several lines keep their boundaries."""
    df.select(id_col, col).write.mode("overwrite").json(path)


def write_audit(lines: DataFrame, path: str) -> None:
    """A11 sink: append JSON lines (the ``line`` column is already JSON)."""
    lines.select("line").write.mode("append").text(path)
