"""Packing of documents into fixed windows by the sum-of-squares rule.

Online bin packing: with ``count[h]`` the number of open windows filled to
level ``h``, a remainder of ``s`` ids goes to the level (or a new window) that
makes the sum of ``count[h] ** 2`` smallest; ties take the fullest window.  Each
task packs the rows of its own split, so packing needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkredact.llm.token_ids import token_ids

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long, ids binary")
_PIECE_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
# Sequences a task may number; the task's own number stands above these bits.
_SEQUENCE_BITS = 36

# A piece before it has a place: document, first id in it, ids, the document's number of ids.
Piece = tuple[int, int, bytes, int]


class Levels:
    """Open windows by level.  ``place`` returns a window that has become full."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def best_level(self, size: int) -> int:
        """Level whose window takes ``size`` ids at the least sum of squares; 0 opens one."""
        top = self.window - size
        here = self.count[1:top + 1]
        change = 2 * (self.count[1 + size:] - here) + 2
        change[-1] -= 1  # a full window leaves the sum; count[window] stays 0
        change[here == 0] = np.iinfo(np.int64).max
        level = top - int(np.argmin(change[::-1]))
        return level if change[level - 1] <= 2 * self.count[size] + 1 else 0

    def place(self, piece: Piece) -> list[Piece] | None:
        size = len(piece[2]) // 4
        level = self.best_level(size)
        if level:
            held = self.at[level].pop()
            self.count[level] -= 1
            self.open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            return held
        self.at.setdefault(level + size, []).append(held)
        self.count[level + size] += 1
        self.open += 1
        return None

    def drain(self) -> Iterator[list[Piece]]:
        """Recut what is open into full windows, then into powers of two, which need no padding."""
        pieces = [p for level in sorted(self.at, reverse=True) for held in self.at[level] for p in held]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.count[:], self.at, self.open = 0, {}, 0
        pieces.reverse()
        while left:
            want = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= want
            held = []
            while want:
                doc, start, ids, total = pieces.pop()
                if len(ids) // 4 > want:
                    pieces.append((doc, start + want, ids[4 * want:], total))
                    ids = ids[:4 * want]
                held.append((doc, start, ids, total))
                want -= len(ids) // 4
            yield held


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, keep_ids: bool = True,
         max_open: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document, with its place in a sequence.

    A document's ids are the tokenizer's plus ``end_id``; a null or empty text
    has the end id alone.  Whole windows of a long document are sequences of
    their own; the remainder is placed by the sum of squares.  When a task ends,
    or ``max_open`` windows are open (the bound of a task's memory), the open
    windows are recut into full ones and at most a dozen powers of two.
    Every id lies in one piece; repeated rows are each packed; an empty table
    gives no row.  Columns other than the two named are not read.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = token_ids(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        levels, rows, made = Levels(window), [], 0

        def put(held: list[Piece]) -> None:
            nonlocal made
            offset = 0
            for doc, start, ids, total in held:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, task << _SEQUENCE_BITS | made, offset, ids if keep_ids else None))
                offset += n
            made += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE_ARROW)], schema=_PIECE_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = coder.ids(text.as_py() or "") + end
                total = len(found) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    put([(doc, start, found[4 * start:4 * (start + window)], total)])
                if total > whole and (full := levels.place((doc, whole, found[4 * whole:], total))):
                    put(full)
                if levels.open >= max_open:
                    for held in levels.drain():
                        put(held)
                if len(rows) >= 2000:
                    yield out()
        for held in levels.drain():
            put(held)
        if rows:
            yield out()

    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return named.mapInArrow(place, PIECE_SCHEMA)
