"""Importance resampling towards a target distribution.

Runs of words are counted in hashed buckets over the corpus and over the target;
a bucket's gain is the scaled log ratio of its two shares.  A document's weight
is the mean gain of its runs, looked up in one array; Gumbel noise, fixed by a
seed and the document's id, turns the highest scores into a draw by weight.

The draw is exact and never sorts the corpus: chunks report the median of the
keys still in question, the driver takes the median of those medians weighted by
the chunks' sizes, and each round discards at least a quarter of what is left
until the cutoff key is known.  Only the winners are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkredact.llm.common import write_table

# Every byte that ends a word becomes a blank, A-Z become a-z; bytes of other scripts stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
# Features worked on at once, in a task.
_STEP = 1 << 21


class _Words(dict):
    """Memo from a word to its crc32 and the bytes that continue a run with it; bounded."""

    def __missing__(self, word: bytes) -> tuple[int, bytes]:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = (crc32(word), b" " + word)
        return found


@lru_cache(maxsize=1)
def _memo() -> _Words:
    return _Words()


def features(text: bytes | None, width: int) -> tuple[int, list[int]]:
    """Number of words, and the crc32 of every run of 1 to ``width`` words."""
    words = (text or b"").translate(_FOLD).split()
    found = list(map(_memo().__getitem__, words))
    run, tails = [f[0] for f in found], [f[1] for f in found]
    out = run
    for k in range(1, min(width, len(words))):
        run = list(map(crc32, tails[k:], run))  # a run's crc goes on from the shorter one's
        out = out + run
    return len(words), out


def _chunks(batch: pa.RecordBatch, column: int, width: int, buckets: int):
    """Slices of the batch as (start, word counts, feature counts, buckets), of bounded size."""
    start, n_words, n_features, found = 0, [], [], []
    held = 0
    texts = batch.column(column).cast(pa.binary())
    for i in range(len(batch)):
        n, own = features(texts[i].as_py(), width)
        n_words.append(n)
        n_features.append(len(own))
        found.append(np.array(own, np.uint32) % np.uint32(buckets))
        held += len(own)
        if held >= _STEP or i == len(batch) - 1:
            yield start, np.array(n_words, np.int64), np.array(n_features, np.int64), np.concatenate(found)
            start, n_words, n_features, found, held = i + 1, [], [], [], 0


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many features of all ``texts`` (one column) fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, own in _chunks(batch, 0, width, buckets):
                total += np.bincount(own, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of the target's smoothed share over the corpus's)."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * float(corpus.sum() + n) / ((s + 1) * float(target.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, width: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain; 0 without words) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for start, n_words, n_features, own in _chunks(batch, 1, width, len(gain)):
                sums = np.zeros(len(n_words), np.int64)
                full = n_features > 0
                if full.any():
                    sums[full] = np.add.reduceat(gain[own], (np.cumsum(n_features) - n_features)[full])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(n_words)), pa.array(n_words), pa.array(n_features), pa.array(sums // np.maximum(n_features, 1))],
                    names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _medians(keys: DataFrame, pivot: tuple[int, int], chunk: int) -> list:
    """Per chunk of at most ``chunk`` keys (a, b) and side of the pivot: number and median."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def report():
            a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            side = np.sign(a.astype(np.float64) - pivot[0]).astype(np.int32)
            side = np.where(a == pivot[0], np.where(b == pivot[1], 0, np.where(b < pivot[1], -1, 1)), side)
            rows = []
            for s in (-1, 0, 1):
                x, y = a[side == s], b[side == s]
                if len(x):
                    middle = np.lexsort((y, x))[(len(x) - 1) // 2]
                    rows.append({"side": s, "n": len(x), "a": int(x[middle]), "b": int(y[middle])})
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("side", pa.int32()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))

        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.slice(at, chunk)
                if n + len(part) > chunk:
                    yield report()
                    held, n = [], 0
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                n += len(part)
        if n:
            yield report()

    return keys.mapInArrow(run, "side int, n long, a long, b long").collect()


def cutoff(keys: DataFrame, k: int, chunk: int = 1 << 18, finish: int = 4096) -> tuple[int, int]:
    """The ``k``-th least of the keys (a, b), neither null, 1 <= k <= their number.

    Each round is one pass over what is left.  The driver holds one row a chunk
    of 262,144 keys, and at the end at most ``finish`` keys.  Keys may repeat.
    """
    def between(keys):
        if low:
            keys = keys.where((F.col("a") > low[0]) | ((F.col("a") == low[0]) & (F.col("b") > low[1])))
        if high:
            keys = keys.where((F.col("a") < high[0]) | ((F.col("a") == high[0]) & (F.col("b") < high[1])))
        return keys

    keys, held = keys.select("a", "b"), None
    pivot, low, high = (1 << 62, 0), None, None  # at first every key is on one side
    while True:
        rows = _medians(between(keys), pivot, chunk)
        n = {s: sum(r["n"] for r in rows if r["side"] == s) for s in (-1, 0, 1)}
        held = held or n[-1]
        if n[-1] < k <= n[-1] + n[0]:
            return pivot
        side = -1 if k <= n[-1] else 1
        if side < 0:
            high = pivot
        else:
            low, k = pivot, k - n[-1] - n[0]
        if n[side] <= finish:
            break
        if 4 * n[side] <= held and n[side] > chunk:  # a smaller table for the next rounds
            keys, held = write_table(between(keys), "keys-left"), n[side]
        rows = sorted((r["a"], r["b"], r["n"]) for r in rows if r["side"] == side)
        reached = np.cumsum([r[2] for r in rows])
        pivot = rows[int(np.searchsorted(reached, (n[side] + 1) // 2))][:2]
    return tuple(sorted((r["a"], r["b"]) for r in between(keys).collect())[k - 1])


def _ranked(winners: DataFrame, order: list) -> DataFrame:
    """``winners`` with their place in ``order`` (from 1): a range sort, then one offset a partition."""
    placed = write_table(winners.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("place", 33)
    offsets, before = [], 0
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row a partition
        offsets.append((row[0], before))
        before += row[1]
    offsets = winners.sparkSession.createDataFrame(offsets, "part long, before long")
    return (placed.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("rank", F.col("before") + F.col("place") - F.shiftleft("part", 33) + 1).drop("part", "before", "place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, width: int = 2,
             seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score and rank.

    The rows drawn are floor(percent * N / 100) of the N with ``least_words``
    words, by the highest score, ties to the smaller doc_id; the others' rank is
    null.  Null and empty texts have no features and weight 0.  Repeated rows
    score alike and are drawn one by one.  A row without doc_id has no score, is
    not counted in N and is never drawn.  An empty target or corpus only
    flattens the gains.  No column but the two is read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    gain = gains(bucket_counts(docs.select("text"), width, buckets), bucket_counts(target.select(target[target_col].alias("text")), width, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = write_table(weigh(docs, gain, width).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = scored.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    k = percent * able.count() // 100
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select("*", none)
    keys = able.select((-F.col("score")).alias("a"), F.col("doc_id").alias("b"))
    a, b = cutoff(keys, k)
    # Rows at the cutoff key itself are repeats of one row; the last of them may stay out.
    within = ((-F.col("score") < a) | ((-F.col("score") == a) & (F.col("doc_id") <= b))) & (F.col("n_words") >= least_words)
    within = F.coalesce(within, F.lit(False))
    drawn = _ranked(scored.where(within), [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")])
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return scored.where(~within).select("*", none).unionByName(drawn)
