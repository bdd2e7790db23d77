"""Pattern detection and redaction on a file stream.

Detection (C1-C17), greedy de-duplication (R1), numbering (W1) and
substitution (R5) are stateless per document in the packed-array form, so the
batch transform runs unchanged on ``readStream`` input with an append sink --
no state store, no watermark (the reference has no cross-request state).
The checkpoint lives under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recognizers as R
from ..operators import detect as D
from ..operators import redact as X
from ..session import shared_dir

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def redact_stream_df(stream: DataFrame, recognizers=None) -> DataFrame:
    """The per-document transform, usable on batch or streaming input."""
    docs = stream.select("doc_id", F.col("text").alias("content"), F.col("lang").alias("language"))
    packed = D.detect_packed(docs, recognizers=recognizers or R.unconfirmed_safe())
    packed = packed.withColumn("ents", F.transform("detected", lambda e: F.struct(
        e["seq"].alias("seq"), e["value"].alias("value"), e["category"].alias("category"),
        e["entity_type"].alias("entity_type"), F.lit(None).cast("string").alias("semantic_role"))))
    out = X.anonymize_packed(packed, "ents")
    return out.select("doc_id", F.size("mappings").cast("bigint").alias("n_mappings"), "anonymized")


def start(spark: SparkSession, source_dir: str, sink_dir: str, glob: str = "*.parquet",
          checkpoint: str | None = None, available_now: bool = True):
    """Start the stream: parquet files in ``source_dir`` -> redacted parquet in
    ``sink_dir``.  ``available_now`` processes what is there and stops.  Without a
    ``checkpoint`` it lies in the shared folder, one for each source and sink."""
    own = hashlib.sha256(f"{source_dir}\n{sink_dir}".encode()).hexdigest()[:16]
    src = (spark.readStream.schema(DOC_SCHEMA).option("pathGlobFilter", glob)
           .option("maxFilesPerTrigger", 64).parquet(source_dir))
    q = (redact_stream_df(src).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or shared_dir(spark, f"redact-stream-{own}"))
         .option("path", sink_dir))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()
