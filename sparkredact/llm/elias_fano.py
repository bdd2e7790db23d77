"""Token ids in binary files with Elias-Fano coded document boundaries.

File format: a Parquet table in a folder every executor reaches, one row per
segment.  A segment holds whole documents in ascending doc_id order:

* ``shard``, ``segment``: position of the row; shards are ranges of doc_id,
* ``start``: ids of the shard before this segment,
* ``n_docs``, ``n_ids``: documents and ids in it,
* ``doc_ids``: array of the documents' ids,
* ``low_bits``, ``low``, ``high``: the documents' ends (a monotone sequence up
  to ``n_ids``) in Elias-Fano code: the lower ``low_bits`` bits of each packed
  end to end, the upper parts in unary,
* ``ids``: the concatenated ids, little-endian unsigned 32-bit integers.

Ends take about ``2 + log2(n_ids / n_docs)`` bits a document in place of a
64-bit offset each.  ``select`` on ``high`` gives the i-th end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkredact.llm.common import new_path
from sparkredact.llm.token_ids import token_ids

SEGMENT_SCHEMA = (
    "shard int, segment int, start long, n_docs int, n_ids long, doc_ids array<long>, "
    "low_bits int, low binary, high binary, ids binary"
)
_SEGMENT_ARROW = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()),
    ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("low_bits", pa.int32()),
    ("low", pa.binary()), ("high", pa.binary()), ("ids", pa.binary()),
])
_DOC_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("shard", pa.int32()), ("in_shard", pa.int64()),
    ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
])


def encode_ends(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """Elias-Fano code of a monotone sequence of non-negative integers."""
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
    low = ((ends[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
    high = np.zeros((top >> low_bits) + n + 1, np.uint8)
    high[(ends >> low_bits) + np.arange(n)] = 1
    return low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


class Ends:
    """Reads the code: ``select(i)`` for single ends, ``all()`` for every end.

    A rank sample every 64 bytes of ``high`` keeps ``select`` to one short scan.
    """

    BLOCK = 64

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        ones = np.bitwise_count(self.high)
        pad = -len(ones) % self.BLOCK
        per_block = np.pad(ones, (0, pad)).reshape(-1, self.BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(per_block)])

    def select(self, i: int) -> int:
        """The i-th value, counted from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        first = block * self.BLOCK
        bits = np.unpackbits(self.high[first:first + self.BLOCK], bitorder="little")
        at = first * 8 + int(np.flatnonzero(bits)[i - self.before[block]])
        value = (at - i) << self.low_bits
        for k in range(self.low_bits):
            b = i * self.low_bits + k
            value |= int(self.low[b >> 3] >> (b & 7) & 1) << k
        return value

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        upper = (at - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return upper
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits)
        return upper | (bits.reshape(self.n, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                segment_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every text and write the files, in ascending order of ``id_col``.

    Documents are dealt to shards by range, sorted inside each, and encoded
    there; a task holds one segment (``segment_ids`` ids, or one document if
    that is longer).  A null text is empty; every document gets ``end_id``.
    Null ids sort first; repeated rows are each kept.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = token_ids(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        names, parts, n_ids, start, segment = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)
            low_bits, low, high = encode_ends(ends)
            row = [shard, segment, start, len(parts), n_ids, names, low_bits, low, high, b"".join(parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SEGMENT_ARROW)], schema=_SEGMENT_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = coder.ids(text.as_py() or "") + end
                if parts and n_ids + len(found) // 4 > segment_ids:
                    yield flush()
                    start, segment = start + n_ids, segment + 1
                    names, parts, n_ids = [], [], 0
                names.append(doc_id)
                parts.append(found)
                n_ids += len(found) // 4
        if parts:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
     .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds the totals of the shards before; there is one total a shard
    (the number of shuffle partitions when written), so the running sum over
    shards is small whatever the number of documents.
    """
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ends = Ends(row["n_docs"], row["low_bits"], row["low"], row["high"]).all()
                starts = np.concatenate([[0], ends[:-1]])
                ids = memoryview(row["ids"])
                sums = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(np.full(len(ends), row["shard"], np.int32)),
                    pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(sums, pa.int64()),
                ], schema=_DOC_ARROW)

    from pyspark.sql import Window

    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = totals.select(
        F.col("shard").alias("of_shard"),
        F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = files.mapInArrow(decode, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long")
    # One row a shard: bounded by the partition count chosen when writing.
    return docs.join(F.broadcast(before), F.col("shard") == F.col("of_shard")).select(
        "doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the files of ``docs`` and return what they say of each document.

    An empty table writes no segment and returns no row.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write_files(docs, path, tokenizer, **options)
    return read_documents(spark, path)
