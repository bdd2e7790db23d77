"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic.  A word's emission is the sum of hashed feature
weights (the word, its first three to six and last three and four characters);
transitions join neighbours.  Forward-backward marginals give each word's
probability of being toxic; runs of toxic words are spans with offsets, and the
expected number, the highest marginal and the length give the document's score.

Labels are of documents, so the words the field learns from are labelled by
association: a word of a toxic document is toxic if one of its features occurs
in toxic documents far more often than chance allows; every other word is clean.
The field is fitted on a bounded sample of labelled rows (``toxic_rows``,
``clean_rows``, ``max_chars``), a block of words at a time; counts of labels are
over all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkredact.llm.common import release_memory

_WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
# Chance of a seed feature by luck: twice the log likelihood ratio, and toxic share of its documents.
SEED_RATIO, SEED_SHARE = 16.0, 0.7


def features(word: str) -> list[int]:
    parts = ("w" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "6" + word[:6], "t" + word[-3:], "u" + word[-4:])
    return [xxhash.xxh32_intdigest(p) % BUCKETS for p in parts]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Chain:
    """Words of several documents end to end, walked in step from their starts or ends."""

    sizes: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes
        by = np.argsort(-self.sizes, kind="stable")
        self.first = self.starts[by]
        sized = self.sizes[by]
        # Documents that still have a word at step t: the first alive[t] of them.
        self.alive = np.searchsorted(-sized, -np.arange(sized[0] if len(sized) else 0), side="left")
        self.last = self.first + sized - 1

    def marginals(self, emission: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of toxic per word, with the filtered and the backward part of it."""
        e = np.exp(np.clip(emission, -30, 30))
        (oo, ot), (to, tt) = np.exp(trans)
        p, q = np.empty(len(e)), np.empty(len(e))
        for t, k in enumerate(self.alive):
            at = self.first[:k] + t
            if t:
                before = p[at - 1]
                toxic, clean = ot + (tt - ot) * before, oo + (to - oo) * before
            else:
                toxic, clean = np.exp(start), 1.0
            toxic = toxic * e[at]
            p[at] = toxic / (toxic + clean)
        for t, k in enumerate(self.alive):
            at = self.last[:k] - t
            if t:
                after = q[at + 1]
                toxic, clean = e[at + 1] * after, 1 - after
                q[at] = (x := to * clean + tt * toxic) / (x + oo * clean + ot * toxic)
            else:
                q[at] = 0.5
        both = p * q
        return both / (both + (1 - p) * (1 - q)), p, q


@dataclass
class Model:
    weights: np.ndarray  # per feature bucket
    bias: float
    trans: np.ndarray
    start: float
    document: np.ndarray  # logistic weights of the document's summary
    constant: float | None = None  # the score where labels of one kind or none exist

    def summary(self, marginal: np.ndarray, chain: Chain) -> np.ndarray:
        """Per document: 1, log of 1 + the expected toxic words, the highest marginal, log of 1 + words."""
        out = np.zeros((len(chain.sizes), 4))
        out[:, 0] = 1
        full = chain.sizes > 0
        if full.any():
            at = chain.starts[full]
            out[full, 1] = np.log1p(np.add.reduceat(marginal, at))
            out[full, 2] = np.maximum.reduceat(marginal, at)
        out[:, 3] = np.log1p(chain.sizes)
        return out


# Words the fit works on at once.
_BLOCK = 200_000


def associations(seen: np.ndarray, share: float) -> np.ndarray:
    """Buckets of features that mark toxic texts: ``seen`` counts the clean and the
    toxic texts with each, ``share`` of all texts are toxic."""
    c0, c1 = seen.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = c1 / (c0 + c1)
        ratio = 2 * (np.where(c1 > 0, c1 * np.log(rate / share), 0) + np.where(c0 > 0, c0 * np.log((1 - rate) / (1 - share)), 0))
        return (rate >= SEED_SHARE) & (ratio >= SEED_RATIO)


def fit(texts: Iterator[str], toxic: np.ndarray, weight: np.ndarray, steps: int = 25, l2: float = 1e-6) -> Model:
    """``toxic`` per text; ``weight`` gives each text the number of labelled rows it
    stands for.

    Kept between steps: an id and a label a word, and the features of each
    distinct word; a step works on blocks of 200,000 words."""
    trans, document = np.zeros((2, 2)), np.zeros(4)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, trans, 0.0, document, float(toxic.mean()) if len(toxic) else 0.0)
    index: dict[str, int] = {}
    blocks: list[tuple[Chain, np.ndarray, np.ndarray]] = []  # a block's documents, word ids and the texts they are of
    found: list[np.ndarray] = []
    first = 0
    for i, text in enumerate(texts):
        found.append(np.array([index.setdefault(w, len(index)) for w in words(text)], np.int32))
        if i == len(toxic) - 1 or sum(map(len, found)) >= _BLOCK:
            blocks.append((Chain(np.array([len(f) for f in found])), np.concatenate(found), np.arange(first, i + 1)))
            found, first = [], i + 1
    # Each distinct word once and in turn: the driver keeps no lists of them, nor a memo.
    feats = np.fromiter((b for w in index for b in features(w)), np.int32, 7 * len(index)).reshape(-1, 7)
    index.clear()
    seen = np.zeros((2, BUCKETS), np.int64)
    for chain, types, of in blocks:
        for i, start, size in zip(of, chain.starts, chain.sizes):
            seen[int(toxic[i])][np.unique(feats[np.unique(types[start:start + size])])] += 1
    seeds = associations(seen, toxic.mean())[feats].any(axis=1)

    def inner_of(chain, n):
        inner = np.ones(n, bool)
        inner[chain.starts[chain.sizes > 0]] = False
        return np.flatnonzero(inner)

    labelled = []
    want = np.zeros((2, 2))
    for chain, types, of in blocks:
        y = seeds[types] & np.repeat(toxic[of], chain.sizes)
        inner = inner_of(chain, len(types))
        np.add.at(want, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        labelled.append(y)

    w, bias, start = np.zeros(BUCKETS), -4.0, -2.0
    # Adam over all parameters: weights, bias, start, four transitions.
    m, v = np.zeros(BUCKETS + 6), np.zeros(BUCKETS + 6)
    for step in range(1, steps + 1):
        by_type = w[feats].sum(axis=1) + bias
        grad, per_type = np.zeros(BUCKETS + 6), np.zeros(len(feats))
        for (chain, types, _), y in zip(blocks, labelled):
            emission = by_type[types]
            marginal, p, q = chain.marginals(emission, trans, start)
            miss = marginal - y
            per_type += np.bincount(types, miss, len(feats))
            grad[BUCKETS] += miss.sum()
            grad[BUCKETS + 1] += miss[chain.starts[chain.sizes > 0]].sum()
            inner = inner_of(chain, len(types))
            a, b, e = p[inner - 1], q[inner], np.exp(np.clip(emission[inner], -30, 30))
            from_to = [(1 - a) * (1 - b), (1 - a) * (e * b), a * (1 - b), a * (e * b)]
            joint = [x * f for x, f in zip(from_to, np.exp(trans).ravel())]
            whole = joint[0] + joint[1] + joint[2] + joint[3]
            grad[BUCKETS + 2:] += [(x / whole).sum() for x in joint]
        for column in feats.T:
            grad[:BUCKETS] += np.bincount(column, per_type, BUCKETS)
        grad[:BUCKETS] += l2 * w
        grad[BUCKETS + 2:] -= want.ravel()
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = 0.4 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w -= move[:BUCKETS]
        bias, start = bias - move[BUCKETS], start - move[BUCKETS + 1]
        trans = np.clip(trans - move[BUCKETS + 2:].reshape(2, 2), -6, 6)

    model = Model(w.astype(np.float32), float(bias), trans, float(start), document)
    by_type = w[feats].sum(axis=1) + bias
    x = np.concatenate([model.summary(chain.marginals(by_type[types], trans, start)[0], chain) for chain, types, _ in blocks])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        s = 1 / (1 + np.exp(-np.clip(x @ document, -30, 30)))
        ridge = 1e-3 * np.eye(4)
        change = np.linalg.solve((x * (weight * s * (1 - s))[:, None]).T @ x + ridge, x.T @ (weight * (s - toxic)) + ridge @ document)
        document = document - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    model.document = document
    return model


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1000, clean_rows: int = 3000, max_chars: int = 20_000) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Associations and weights are of at most ``toxic_rows`` and ``clean_rows``, drawn
    in the order of a hash of doc_id from the given documents that are labelled
    and have at most ``max_chars`` characters (so the sample is bounded in bytes
    too); each stands for its share of the labelled documents.  Null labels and
    null ids are left out; of several labels of one document the highest holds;
    repeated documents count again.
    """
    of = (labels.select(labels["doc_id"].alias("of_doc"), labels["toxic"].alias("toxic"))
          .where("toxic is not null and of_doc is not null and not crc32(cast(of_doc as string)) % 3 = 1")
          .groupBy("of_doc").agg((F.max("toxic") >= 1).alias("toxic")))
    given = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where(F.length("text") <= max_chars)
    able = given.select("doc_id").join(of, F.col("doc_id") == F.col("of_doc")).select("doc_id", "toxic")  # no text is shuffled
    total = {bool(r[0]): r[1] for r in able.groupBy("toxic").count().collect()}
    parts = [able.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
             for kind, limit in ((True, toxic_rows), (False, clean_rows))]
    sample = parts[0].unionAll(parts[1]).select(F.col("doc_id").alias("of_doc"), "toxic").distinct()
    rows = (given.join(F.broadcast(sample), F.col("doc_id") == F.col("of_doc"))  # two limits bound it
            .select("doc_id", "text", "toxic").orderBy("doc_id", "text").limit(toxic_rows + clean_rows).toArrow())
    toxic = rows["toxic"].to_numpy().astype(bool)
    counted = {kind: max(1, int((toxic == kind).sum())) for kind in (True, False)}
    weight = np.array([total.get(bool(k), 0) / counted[bool(k)] for k in toxic])
    model = fit((t.as_py() for t in rows["text"]), toxic, weight)
    del rows
    release_memory()
    return model


# Texts scored at once: their words and the chain's arrays are all in a worker's memory.
BLOCK = 1000


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, BLOCK) for at in range(0, len(batch), BLOCK))


class Emissions(dict):
    """Memo from a word to its emission; per worker and model, bounded."""

    def __init__(self, model: Model, limit: int = 100_000):
        super().__init__()
        self.weights, self.bias, self.limit = model.weights.tolist(), model.bias, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = self.bias + sum(map(self.weights.__getitem__, features(word)))
        return found


def _scores(texts: list[str | None], model: Model, memo: Emissions, with_spans: bool):
    """Scores of the texts, and their toxic spans (start, end, highest marginal)."""
    spans: list[list[dict]] = [[] for _ in texts]
    if model.constant is not None:
        return np.full(len(texts), model.constant), spans
    found = [words(t) for t in texts]
    chain = Chain(np.array([len(f) for f in found], np.int64))
    emission = np.fromiter((memo[w] for f in found for w in f), np.float64, int(chain.sizes.sum()))
    marginal = chain.marginals(emission, model.trans, model.start)[0]
    # Rounded: sums may differ in the last place with a text's place in its batch.
    score = np.round(1 / (1 + np.exp(-np.clip((model.summary(marginal, chain) * model.document).sum(axis=1), -30, 30))), 12)
    if with_spans:
        marked = np.flatnonzero(marginal >= 0.5)
        owner = np.searchsorted(chain.starts, marked, side="right") - 1
        for d in np.unique(owner):
            low = texts[d].lower()
            # Lower-casing may change lengths; then offsets are those of the lower-cased text.
            at = [m.span() for m in _WORD.finditer(low)]
            before = None
            for i in (marked[owner == d] - chain.starts[d]).tolist():
                p = float(marginal[chain.starts[d] + i])
                if before == i - 1:
                    spans[d][-1] = {"start": spans[d][-1]["start"], "end": at[i][1], "p": max(p, spans[d][-1]["p"])}
                else:
                    spans[d].append({"start": at[i][0], "end": at[i][1], "p": p})
                before = i
    return score, spans


_SPANS = "array<struct<start: int, end: int, p: double>>"


def score(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1) and spans of toxic words.

    Null and empty texts get the score of a text without words.  Repeated rows
    get equal scores.  No column but the text enters a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Emissions(shared.value)
        for batch in batches:
            for part in blocks(batch):
                found, spans = _scores(part.column(1).to_pylist(), shared.value, memo, with_spans)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array(spans, span)], names=["doc_id", "score", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(
        run, f"doc_id long, score double, spans {_SPANS}")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Emissions(shared.value)
        for batch in batches:
            for part in blocks(batch):
                found, _ = _scores(part.column(text).to_pylist(), shared.value, memo, False)
                yield part.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
