"""Language identification by bit-sliced Bloom filters of letter n-grams.

One table holds the filters of all languages: its rows are the filters' bits, a
row has one bit a language.  An n-gram's rows, combined by AND, give the set of
languages that contain it in one lookup.  Per text the hits of each language are
counted and corrected by the rate at which its filter, as full as it is, hits
by chance; the language with the highest corrected count is chosen.

A language contains an n-gram if enough of its documents hold it, and if that
share is a good part of the highest share of any language: an n-gram that is
common elsewhere and rare here says nothing for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
# Letters of a text that are worked on at once, and counted n-grams a task holds.
_STEP, _HELD = 1 << 20, 1 << 22
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
MAX_LANGUAGES = 4096


class _Letters:
    """Code points to the code of their lower-case letter, 0 for all that is no letter; learned as met."""

    def __init__(self):
        self.known = np.zeros(0x110000, bool)
        self.fold = np.zeros(0x110000, np.uint32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        for c in np.unique(codes[~self.known[codes]]).tolist():
            low = chr(c).lower()
            self.fold[c] = 0 if not chr(c).isalpha() else ord(low) if len(low) == 1 else c
            self.known[c] = True
        return self.fold[codes]


_letters = _Letters()


def grams(text: str, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Hashes of the n-grams inside words, a word's ends counting as one character; in pieces.

    A piece overlaps the next by the longest n-gram less one, so none is lost or
    counted twice.
    """
    longest = max(sizes)
    for at in range(0, len(text) + 1, _STEP):
        # One character more on each side stands for the end of the first and last word.
        piece = text[max(at - 1, 0):at + _STEP + longest - 2]
        codes = _letters(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32))
        codes = np.concatenate([np.zeros(int(at == 0), np.uint32), codes, np.zeros(int(at + _STEP + longest - 2 > len(text)), np.uint32)]).astype(np.uint64)
        inner = codes > 0
        for size in sizes:
            n = min(len(codes) - size + 1, _STEP)
            if n <= 0:
                continue
            whole = inner[1:1 + n].copy()
            h = codes[:n] * _FACTORS[0] + np.uint64(size)
            for i in range(1, size):
                if i < size - 1:
                    whole &= inner[i:i + n]
                h += codes[i:i + n] * _FACTORS[i]
            h = h[whole]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield (h ^ (h >> np.uint64(29))).view(np.int64)


@dataclass
class Model:
    languages: list[str]  # the commonest first
    rows: np.ndarray  # (rows, words of 64 languages): the bit-sliced filters
    hashes: int
    by_chance: np.ndarray  # per language the rate of hits of n-grams it doesn't hold
    sizes: tuple[int, ...]

    def hits(self, found: np.ndarray) -> np.ndarray:
        """Per language the number of the n-grams that its filter holds."""
        low, high = found & 0xFFFFFFFF, (found >> 32) & 0xFFFFFFFF | 1
        mask = self.rows[low % len(self.rows)]
        for i in range(1, self.hashes):
            mask = mask & self.rows[(low + i * high) % len(self.rows)]
        bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little", count=len(self.languages))
        return bits.sum(axis=0, dtype=np.int64)

    def judge(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        n, hit = 0, np.zeros(len(self.languages))
        for found in grams(text, self.sizes):
            n += len(found)
            hit += self.hits(found)
        true = np.maximum((hit - n * self.by_chance) / np.maximum(1 - self.by_chance, 1e-9), 0)
        best = int(true.argmax())  # of equals the commoner language
        second = np.delete(true, best).max(initial=0)
        return self.languages[best], float(true[best] / (true[best] + second)) if true[best] > 0 else 0.0


def _gram_counts(docs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """lang, gram, n: in how many documents of the language the n-gram is; partial sums of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def report():
            for lang, parts in held.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, lang in enumerate(langs):
                parts = list(grams(batch.column(1)[i].as_py(), sizes))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                held.setdefault(lang, []).append(own)
                size += len(own)
                if size >= _HELD:
                    yield from report()
                    held, size = {}, 0
        yield from report()

    return docs.mapInArrow(run, "lang string, gram long, n long")


def train(docs: DataFrame, sizes: tuple[int, ...] = (3, 4), rows: int = 1 << 20, hashes: int = 3, least_share: float = 0.001, of_highest: float = 0.25) -> Model:
    """Filters of all texts of ``docs`` (lang, text) whose language isn't null.

    A language holds an n-gram that at least two and ``least_share`` of its
    documents have, and at least ``of_highest`` of the share in any language.
    Everything counts all rows; the driver gets a row a language and one a filter
    bit, at most ``rows`` for every 64 languages.
    """
    docs = docs.where("lang is not null and text is not null")
    by = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(by) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not by:
        return Model([], np.zeros((1, 1), np.uint64), hashes, np.zeros(0), sizes)
    sized = F.broadcast(docs.sparkSession.createDataFrame([(r[0], i, r[1]) for i, r in enumerate(by)], "lang string, id int, docs long"))
    counts = _gram_counts(docs.select("lang", "text"), sizes).groupBy("gram", "lang").agg(F.sum("n").alias("n")).join(sized, "lang")
    counts = counts.withColumn("share", F.col("n") / F.col("docs")).where((F.col("n") >= 2) & (F.col("share") >= least_share))
    sets = counts.groupBy("gram").agg(F.collect_list(F.struct("id", "share")).alias("langs"))  # at most a row a language
    held = sets.withColumn("top", F.array_max("langs.share")).select("gram", F.explode("langs").alias("l"), "top").where(F.col("l.share") >= of_highest * F.col("top"))
    # The same double hashing as Model.hits.
    low, high = F.col("gram").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("long"))
    places = F.array(*((low + i * high) % rows for i in range(hashes)))
    bits = (held.select(F.explode(places).alias("row"), F.floor(F.col("l.id") / 64).cast("int").alias("word"),
                        F.expr("shiftleft(1L, l.id % 64)").alias("bit"))
            .groupBy("row", "word").agg(F.bit_or("bit").alias("bits")).toArrow())
    table = np.zeros((rows, (len(by) + 63) // 64), np.uint64)
    table[bits["row"].to_numpy(), bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    full = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(by))])
    return Model([r[0] for r in by], table, hashes, full ** hashes, sizes)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, lang_pred and score (the share of the best in the best two's hits).

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned; the commonest language with score 0 where no language knows an
    n-gram.  Ties go to the commoner language, then by code point.  Whole texts
    of any length are read in pieces.  No column but the text enters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the size of its rows, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.judge(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
