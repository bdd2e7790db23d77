"""Where a document's values stand: one pass over a text for all its values.

An automaton over all values of a document finds every occurrence of every
value in one pass, so the work is the text's length plus the occurrences,
however many values there are; up to ``FEW`` are searched one by one.  The columns here are Arrow UDFs over one row a
document; nothing is exploded and no text is copied per entity.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab

_PLACES, _LISTS = T.ArrayType(T.IntegerType()), T.ArrayType(T.ArrayType(T.IntegerType()))
_FACTS = T.StructType([T.StructField("first", _PLACES), T.StructField("legal", T.ArrayType(T.BooleanType())),
                       T.StructField("related", _LISTS), T.StructField("near", _LISTS)])


# So many values are searched one by one: building an automaton for them takes longer.
FEW = 32


class Finder:
    """All occurrences of several values, overlapping ones too."""

    def __init__(self, values: Iterable[str | None]):
        self.values = list(dict.fromkeys(v for v in values if v))
        self.machine = None
        if len(self.values) > FEW:
            self.machine = ahocorasick.Automaton()
            for v in self.values:
                self.machine.add_word(v, v)
            self.machine.make_automaton()

    def __call__(self, text: str | None) -> Iterator[tuple[int, str]]:
        """(start, value) of every occurrence, in no order."""
        if not text:
            return
        if self.machine is not None:
            for end, value in self.machine.iter(text):
                yield end - len(value) + 1, value
            return
        for value in self.values:
            at = text.find(value)
            while at >= 0:
                yield at, value
                at = text.find(value, at + 1)


def _places(values: list[str | None]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None:
            out.setdefault(v, []).append(i)
    return out


def related_rows(left: list[str | None], right: list[str | None], empty_too: bool = False) -> list[list[int]]:
    """Per left value the right ones, in order, that contain it or that it contains.

    Empty values relate to nothing, or to everything with ``empty_too``."""
    if len(left) <= FEW and len(right) <= FEW:
        known = [(j, b) for j, b in enumerate(right) if b or empty_too and b is not None]
        of = {a: [j for j, b in known if a in b or b in a] for a in set(left) if a or empty_too and a is not None}
        return [of.get(a, []) for a in left]
    found: list[set[int]] = [set() for _ in left]
    lefts, rights = _places(left), _places(right)
    find_right, find_left = Finder(rights), Finder(lefts)
    for value, at in lefts.items():
        inside = {j for _, v in find_right(value) for j in rights[v]}
        for i in at:
            found[i] |= inside
    for value, at in rights.items():
        for v in {v for _, v in find_left(value)}:
            for i in lefts[v]:
                found[i].update(at)
    if empty_too:
        known = [j for v in rights.values() for j in v]
        for i in lefts.get("", []):
            found[i].update(known)
        for at in lefts.values():
            for i in at:
                found[i].update(rights.get("", []))
    return [sorted(f) for f in found]


@F.arrow_udf(_LISTS)
def _related(left: pa.Array, right: pa.Array) -> pa.Array:
    rows = [related_rows(a or [], b or []) for a, b in zip(left.to_pylist(), right.to_pylist())]
    return pa.array(rows, pa.list_(pa.list_(pa.int32())))


# Declared nondeterministic, so that the optimizer keeps their results as columns: written
# into the lambdas that read them they could not run.
def related(left: Column, right: Column) -> Column:
    """D-1 for one document a row: per left value the 0-based places of the right ones related to it."""
    return _related.asNondeterministic()(left, right)


def near_phrase(text: str | None, values: list[str | None], phrases: list[str], window: int) -> list[bool]:
    """Per value whether one of its occurrences ends or starts at most ``window`` before or after a phrase."""
    wanted = {v for v in values if v}
    if not wanted or not text:
        return [False] * len(values)
    starts, ends, found = [], [], []
    for start, v in Finder([*phrases, *wanted])(text):
        if v in phrases:
            starts.append(start)
            ends.append(start + len(v))
        if v in wanted:
            found.append((start, v))
    starts.sort()
    ends.sort()
    hit = set()
    for start, v in found:
        if v not in hit:
            stop = start + len(v)
            a, b = bisect_left(ends, start - window), bisect_left(starts, stop)
            if a < len(ends) and ends[a] <= start or b < len(starts) and starts[b] <= stop + window:
                hit.add(v)
    return [v in hit for v in values]


def first_places(text: str | None, values: list[str | None]) -> list[int]:
    """Per value the 0-based start of its first occurrence, -1 without one."""
    if len(values) <= FEW:
        return [text.find(v) if text and v else -1 for v in values]
    first: dict[str, int] = {}
    for start, v in Finder(values)(text):
        if start < first.get(v, len(text) + 1):
            first[v] = start
    return [first.get(v, -1) for v in values]


def neighbours(places: list[int], most: int) -> list[list[int]]:
    """Per place the others at most ``most`` away, nearest first, of equals the earlier in the list."""
    order = sorted((p, i) for i, p in enumerate(places) if p >= 0)
    out: list[list[int]] = [[] for _ in places]
    lo, hi, n = 0, 0, len(places)
    for p, i in order:
        while order[lo][0] < p - most:
            lo += 1
        while hi < len(order) and order[hi][0] <= p + most:
            hi += 1
        out[i] = [key % n for key in sorted([abs(q - p) * n + j for q, j in order[lo:hi] if j != i])]
    return out


@F.arrow_udf(_FACTS)
def _value_facts(text: pa.Array, lower: pa.Array, values: pa.Array, candidates: pa.Array, norms: pa.Array) -> pa.Array:
    phrases = [p.lower() for p in vocab.LEGAL_CONTEXT_PHRASES]
    rows = []
    for t, low, vs, cs, ns in zip(*(x.to_pylist() for x in (text, lower, values, candidates, norms))):
        vs, cs, ns = vs or [], cs or [], ns or []
        first = first_places(t, vs)
        rows.append({"first": first, "legal": near_phrase(low, cs, phrases, vocab.LEGAL_CONTEXT_WINDOW),
                     "related": [[j for j in r if j != i] for i, r in enumerate(related_rows(ns, ns, True))],
                     "near": neighbours(first, vocab.PROXIMITY_THRESHOLD)})
    lists = pa.list_(pa.list_(pa.int32()))
    return pa.array(rows, pa.struct([("first", pa.list_(pa.int32())), ("legal", pa.list_(pa.bool_())), ("related", lists), ("near", lists)]))


def value_facts(text: Column, values: Column, candidates: Column, norms: Column) -> Column:
    """What the later steps ask about the values of a document, from one pass over its text.

    ``first``: 0-based first occurrence (D-17); ``legal``: whether the value in
    ``candidates`` (lower-cased, null to skip) is near a legal phrase (D-12);
    ``related``: places of the values whose ``norms`` contain, or lie in, its own
    (D-16); ``near``: places of those first found within 200 characters, nearest
    first (D-17)."""
    return _value_facts.asNondeterministic()(text, F.lower(text), values, candidates, norms)


@F.arrow_udf(T.StringType())
def _replace_once(text: pa.Array, originals: pa.Array, replacements: pa.Array) -> pa.Array:
    return pa.array([replace_once(t, dict(zip(reversed(o or []), reversed(r or [])))) for t, o, r in
                     zip(text.to_pylist(), originals.to_pylist(), replacements.to_pylist())], pa.string())


def replace_once(text: str | None, mapping: dict[str, str]) -> str | None:
    """Every value replaced in one pass, leftmost first and of those the longest; what was put in is not read again."""
    if not text:
        return text
    longest: dict[int, str] = {}
    for start, v in Finder(mapping)(text):
        if len(v) > len(longest.get(start, "")):
            longest[start] = v
    out, at = [], 0
    for start in sorted(longest):
        if start >= at:
            out += [text[at:start], mapping[longest[start]]]
            at = start + len(longest[start])
    return "".join([*out, text[at:]])


def substitute_once(text: Column, mappings: Column) -> Column:
    """R5 with ``isolate``: all mappings in one pass; of equal originals the first mapping holds."""
    return _replace_once(text, F.transform(mappings, lambda m: m["original"]), F.transform(mappings, lambda m: m["replacement"]))
