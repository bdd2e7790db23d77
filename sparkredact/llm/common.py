"""Shared storage for the operators' written tables, and small column helpers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the contracts: runs of anything but space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may run without one; it then gets its own folder.
    On a cluster a machine-local folder would lose rows, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-run.  The shuffle files
    of the write go with its end, not when the driver happens to collect garbage, so a
    chain of tables needs the disk of one step at a time.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_FILE_CLEANUP, None)
    conf.set(_FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_FILE_CLEANUP) if before is None else conf.set(_FILE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_memos: dict = {}


def worker_memo(key, make):
    """A Python worker's memo ``key``, made by ``make`` and kept between its tasks.

    A worker serves the tasks of one operator after another and holds one memo at a
    time: that of the operator before it is freed first."""
    if key not in _memos:
        _memos.clear()
        _memos[key] = make()
    return _memos[key]


def release_memory() -> None:
    """Hand freed memory back to the system, where the C library can: a driver that has
    fitted a model lives on for all later steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of the contracts in a text; null counts none.

    Collapses each word to one character, then drops the white space.
    """
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_PATTERN, "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")
