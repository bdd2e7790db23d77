"""Requests against the documents that were live at their time (D-23, T1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab

NOT_FOUND, EXPIRED = "document not found", "document expired"


def look_up(requests: DataFrame, stored: DataFrame, ttl_seconds: int = vocab.CACHE_TTL_SECONDS, bin_seconds: int = 3600) -> DataFrame:
    """``requests`` (request_id, doc_id, at) with ``created_at`` of the version
    that was live then, or a ``reason`` why none was.

    ``stored`` (doc_id, created_at) holds a row a version; a version is live from
    created_at until ttl_seconds later, both included, and the newest counts.

    As expiry follows creation, only the newest version up to the request can be
    live.  It is found in the request's own time bin, or as the newest of the
    bins before: a document with very many requests is as many tasks as it has
    bins, and no pair of a request and an older version is made.  A request
    without an id or a time isn't found; repeated rows are answered one by one.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bin_ = F.floor(F.col("t") / (bin_seconds * 1_000_000))
    asked = requests.select("doc_id", micros("at").alias("t"), F.lit(1).alias("kind"), F.struct("request_id", "at").alias("asked"))
    kept = stored.where("doc_id is not null and created_at is not null").select(
        "doc_id", micros("created_at").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["asked"].dataType).alias("asked"))
    rows = kept.unionByName(asked).withColumn("bin", bin_).withColumn("version", F.when(F.col("kind") == 0, F.col("t")))
    in_bin = Window.partitionBy("doc_id", "bin").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("in_bin", F.last("version", ignorenulls=True).over(in_bin)).where("kind = 1")
    bins = kept.unionByName(asked).withColumn("bin", bin_).groupBy("doc_id", "bin").agg(F.max(F.when(F.col("kind") == 0, F.col("t"))).alias("newest"))
    before = Window.partitionBy("doc_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.max("newest").over(before)).where("before is not null").select("doc_id", "bin", "before")
    found = rows.join(bins, ["doc_id", "bin"], "left").withColumn("version", F.coalesce("in_bin", "before"))
    live = F.col("version").isNotNull() & (F.col("t") - F.col("version") <= F.lit(ttl_seconds * 1_000_000))
    reason: Column = F.when(F.col("version").isNull(), F.lit(NOT_FOUND)).when(~live, F.lit(EXPIRED))
    return found.select("asked.request_id", "doc_id", "asked.at", F.when(live, F.timestamp_micros("version")).alias("created_at"), reason.alias("reason"))


def split_errors(answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests that go on, and the error table."""
    return answered.where("reason is null").drop("reason"), answered.where("reason is not null").drop("created_at")
