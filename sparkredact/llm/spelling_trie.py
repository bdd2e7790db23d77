"""Spelling variants by a trie over letter-group counts.

A word's letters are counted in groups; its counts, one level a group, are its
path in a trie.  One inserted, deleted or replaced letter moves the counts by a
surplus of at most one and a deficit of at most one, so a depth-first search
that may spend one of each meets every near word; what it finds in a leaf is
verified letter by letter.

The trie's leaves in depth-first order are the words in the order of their
counts, so a range sort cuts it into blocks of bounded size.  A search walks the
list of the blocks' first paths, of bounded length, until a branch lies within
one block; there it goes on inside the block's task.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkredact.llm.common import write_table

# Levels of the trie: a letter shares its group with the one thirteen places on.
GROUPS = 13
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Words of a block, blocks, rows of searches dealt to one task, and words a task counts before it reports.
BLOCK, MOST_BLOCKS, _DEALT, _HELD = 8192, 1 << 16, 1 << 18, 1 << 19


def altered(doc_id: int | None, run: str, every: int = 31) -> str:
    """``run``, without one letter if the crc32 of ``<doc_id>:<run>`` is a multiple of ``every``."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[:(at := h % len(run))] + run[at + 1:]


def word_counts(docs: DataFrame, least_letters: int) -> DataFrame:
    """word, n: partial sums of the altered runs of letters, of ``least_letters`` and more."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def report():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found, n in Counter(runs.findall(text.as_py().translate(_LOWER))).items():
                    word = altered(doc_id, found)
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) >= _HELD:
                    yield report()
                    held.clear()
        yield report()

    return docs.where("text is not null").mapInArrow(run, "word string, n long")


def paths(words: list[str]) -> np.ndarray:
    """Letter-group counts of each word, a row a word; counts past 255 stay there, which moves no count further apart."""
    raw = [w.encode("latin-1") for w in words]
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    group = (np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) - 97) % GROUPS
    return np.minimum(np.bincount(owner * GROUPS + group, minlength=len(raw) * GROUPS).reshape(len(raw), GROUPS), 255).astype(np.uint8)


def _keyed(words: DataFrame) -> DataFrame:
    """Words with their path as bytes, which sort like the trie's leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [bytes(p) for p in paths(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), *batch.columns], names=["path", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "path binary, word string, n long")


def _as_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _spent(moved: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seeks that may go on, with what they have spent: a surplus of one, then a
    deficit of one.  A pair whose deficit comes first is found from its other word."""
    up, down = surplus + np.maximum(moved, 0), deficit + np.maximum(-moved, 0)
    ok = np.flatnonzero((up <= 1) & (down <= up))
    return ok, up[ok], down[ok]


def search(leaves: np.ndarray, seeks: np.ndarray, reached, few: int = 8) -> None:
    """Depth-first over the sorted ``leaves``, all of ``seeks`` together.

    Calls ``reached(lo, hi, who, surplus, deficit, depth)`` where a branch is a
    leaf or has ``few``: ``leaves[lo:hi]`` agree with the seeks ``who`` down to
    ``depth`` within the budget they have spent.
    """
    start = np.zeros(len(seeks), np.int8)
    todo = [(0, len(leaves), 0, np.arange(len(seeks)), start, start)]
    columns = np.ascontiguousarray(seeks.T.astype(np.int16))
    while todo:
        lo, hi, depth, who, surplus, deficit = todo.pop()
        if depth == GROUPS or hi - lo <= few:
            reached(lo, hi, who, surplus, deficit, depth)
            continue
        level = leaves[lo:hi, depth]
        cuts = [0, *(np.flatnonzero(level[1:] != level[:-1]) + 1).tolist(), hi - lo]
        own = columns[depth, who]
        for a, b in zip(cuts[:-1], cuts[1:]):
            ok, up, down = _spent(int(level[a]) - own, surplus, deficit)
            if len(ok):
                todo.append((lo + a, lo + b, depth + 1, who[ok], up.astype(np.int8), down.astype(np.int8)))


def _blocks_of(seeks: np.ndarray, firsts: list[bytes], lasts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(seek, block) for every block with a path that a seek reaches within its budget.

    Walks the paths between each block's first and last depth-first: a child of a
    branch is a count, and the blocks that hold it are an interval.
    """
    start = np.zeros(len(seeks), np.int8)
    todo = [(0, len(firsts), 0, b"", np.arange(len(seeks)), start, start)]
    while todo:
        lo, hi, depth, prefix, who, surplus, deficit = todo.pop()
        if depth == GROUPS or hi - lo == 1:
            for block in range(lo, hi):
                yield who, np.full(len(who), block)
            continue
        own = seeks[who, depth].astype(np.int16)
        for count in np.unique(np.clip(np.concatenate([own - 1, own, own + 1]), 0, 255)).tolist():
            branch = prefix + bytes([count])
            # Blocks whose interval of paths meets those that begin with ``branch``.
            a = bisect_left(lasts, branch, lo, hi)
            b = bisect_right(firsts, branch + b"\xff" * (GROUPS - depth - 1), lo, hi)
            if a < b:
                ok, up, down = _spent(count - own, surplus, deficit)
                if len(ok):
                    todo.append((a, b, depth + 1, branch, who[ok], up.astype(np.int8), down.astype(np.int8)))


# Letters of the words that are kept as rows; longer words are cut out of their text as needed.
_SHORT = 32


class _Words:
    """Words as rows of letters."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        self.short = np.frombuffer(b"".join(r[:_SHORT].ljust(_SHORT, b"\0") for r in raw), np.uint8).reshape(-1, _SHORT)

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """The words ``at``, filled with 0 to ``width``."""
        if width <= _SHORT:
            return self.short[at, :width]
        n = np.arange(width)
        inside = n < self.sizes[at, None]
        return np.where(inside, self.letters[np.minimum(self.starts[at, None] + n, len(self.letters) - 1)], 0)


def one_apart(short: _Words, x: np.ndarray, long: _Words, y: np.ndarray, same_path: np.ndarray | None = None) -> np.ndarray:
    """Whether each pair differs by exactly one letter replaced, or inserted into the
    first.  Replaced pairs under the same path count only from the smaller word."""
    out = np.zeros(len(x), bool)
    by = np.argsort(long.sizes[y], kind="stable")
    at = 0
    while at < len(by):
        width = int(long.sizes[y[by[at]]])
        part = by[at:at + max(1, (1 << 20) // max(width, 1))]
        part = part[long.sizes[y[part]] <= 2 * width + 8]
        at += len(part)
        width = int(long.sizes[y[part[-1]]])
        a, b = short.rows(x[part], width), long.rows(y[part], width)
        n_a, n_b = short.sizes[x[part]], long.sizes[y[part]]
        differ = a != b
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        replaced = (n_a == n_b) & (differ.sum(axis=1) == 1)
        if same_path is not None:
            k = np.arange(len(part))
            less = a[k, np.minimum(first, width - 1)] < b[k, np.minimum(first, width - 1)]
            replaced &= less | ~same_path[part]
        # Up to the first difference they agree; past it the longer one is shifted by one.
        shifted = np.zeros_like(a)
        shifted[:, 1:] = a[:, :-1]
        rest = ((np.arange(width) > first[:, None]) & (shifted != b)).any(axis=1)
        out[part] = replaced | ((n_a + 1 == n_b) & ~rest)
    return out


def _pairs(seeks: pa.Table, leaves: pa.Table) -> pa.Table:
    """Near pairs of the words that search (seeks) with those of one block (leaves)."""
    none = pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "n_a": pa.array([], pa.int64()), "n_b": pa.array([], pa.int64())})
    if not seeks.num_rows or not leaves.num_rows:
        return none
    leaves, seeks = leaves.sort_by("path"), seeks.sort_by("path")
    own, other = _as_rows(leaves["path"]), _as_rows(seeks["path"])
    words, wanted = _Words(leaves["word"].to_pylist()), _Words(seeks["word"].to_pylist())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_held = 0

    def verify():
        x, y, same = (np.concatenate([p[i] for p in held]) for i in (0, 1, 2))
        ok = one_apart(wanted, x, words, y, same)
        found.append((x[ok], y[ok]))
        held.clear()

    def reached(lo, hi, who, surplus, deficit, depth):
        nonlocal n_held
        for at in range(lo, hi, 64):
            part = np.arange(at, min(at + 64, hi))
            moved = own[part, None, depth:].astype(np.int8) - other[None, who, depth:].astype(np.int8)
            up, down = (moved > 0).sum(axis=2) + surplus, (moved < 0).sum(axis=2) + deficit
            longer = words.sizes[part, None] - wanted.sizes[None, who]
            ok = (up <= 1) & (down <= up) & ((longer == 0) | (longer == 1))
            if depth < GROUPS:  # a deficit never before the surplus
                ok &= np.cumsum(moved, axis=2, dtype=np.int8).min(axis=2) + surplus - deficit >= 0
            leaf, seek = np.nonzero(ok)
            held.append((who[seek], part[leaf], (up + down)[leaf, seek] == 0))
            n_held += len(leaf)
        if n_held >= 1 << 17:
            verify()
            n_held = 0

    search(own, other, reached)
    if held:
        verify()
    if not found:
        return none
    x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return pa.table({"a": seeks["word"].take(x), "b": leaves["word"].take(y), "n_a": seeks["n"].take(x), "n_b": leaves["n"].take(y)})


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``words`` (word, n), distinct, to pairs a, b, n_a, n_b one letter apart, each once.

    Blocks hold about ``block`` words, more once there are more than 65,536
    blocks.  The searches that reach a block are dealt to several tasks if many.
    """
    spark = words.sparkSession
    total = words.count()
    blocks = min(MOST_BLOCKS, -(-total // block))
    if not blocks:
        return spark.createDataFrame([], "a string, b string, n_a long, n_b long")
    trie = write_table(_keyed(words).repartitionByRange(blocks, "path", "word").withColumn("block", F.spark_partition_id()), "trie")
    # A row a block, so at most MOST_BLOCKS of them.
    listed = sorted(trie.groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last")).collect(), key=lambda r: (bytes(r["first"]), bytes(r["last"])))
    numbers = np.array([r["block"] for r in listed], np.int32)
    ends = spark.sparkContext.broadcast([[bytes(r[k]) for r in listed] for k in ("first", "last")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                seen = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_blocks_of(_as_rows(part.column(0)), *ends.value)]
                pairs = np.unique(np.concatenate([s[0] * len(numbers) + s[1] for s in seen]))  # several branches may meet in a block
                who, which = np.divmod(pairs, len(numbers))
                rows = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(numbers[which]), *rows.columns], names=["block", "path", "word", "n"])

    seeks = write_table(trie.select("path", "word", "n").mapInArrow(walk, "block int, path binary, word string, n long"), "seeks")
    shares = seeks.groupBy("block").agg(F.ceil(F.count("*") / _DEALT).cast("int").alias("shares"))
    seeks = seeks.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("word"), F.col("shares")).cast("int"))
    dealt = trie.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    columns = ["block", "share", "path", "word", "n"]
    return (seeks.select(columns).groupBy("block", "share").cogroup(dealt.select(columns).groupBy("block", "share"))
            .applyInArrow(_pairs, "a string, b string, n_a long, n_b long"))


def _roots(forms: DataFrame, rounds: int = 8) -> DataFrame:
    """``forms`` (word, form) to word, root: the end of each chain, by doubling.

    A form is at least ten times as frequent as its word, so no chain has more
    than 19 steps and five rounds do; a loop can't be.
    """
    now = write_table(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = write_table(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return now


def variants(docs: DataFrame, least_letters: int = 7, least_n: int = 2, factor: int = 10, id_col: str = "doc_id", text_col: str = "text",
             block: int = BLOCK) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the altered runs of letters (``altered``) of ``least_letters`` and
    more that occur ``least_n`` times in all texts.  A word's form is its most
    frequent near word (ties: the first by code point) if that has ``factor``
    times its n, else null; its root is the last of its forms' forms, or itself.
    Null and empty texts hold no words; a null doc_id counts as the empty text
    before the colon; repeated rows count again.  No word gives no row.  No
    column but the two is read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    words = write_table(word_counts(docs, least_letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n), "words")
    pairs = write_table(near_pairs(words, block), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best")).alias("best"))
    known = write_table(known.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n")), "forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
