"""Pattern recognisers compiled to Column expressions.

A :class:`Recognizer` is a named regex with a base score, optional context
words (score boost when one appears shortly before the match) and an optional
validator (checksum) that is itself a Column expression.  ``match_array``
turns a list of recognisers into ONE array column per document holding every
match with its character offset -- a narrow, per-row computation, so detection
never shuffles and scales with the number of text partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Optional

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims, vocab
from . import checks
from .binding import let

# Characters of text before a match that are searched for context words, by default:
# our stand-in for a window of five words, see ``Recognizer.context_chars``.
CONTEXT_WINDOW_CHARS = 50


@dataclass(frozen=True)
class Recognizer:
    detector_type: str
    pattern: str
    score: float
    context: tuple = ()
    validator: Optional[Callable[[Column], Column]] = field(default=None, compare=False)
    # When set, the entity value is this capture group, which must end the match.
    group: int = 0
    # Literal that every match contains: rows without it skip the regex scan.
    requires: Optional[str] = None
    # Every match contains a digit: rows without any digit skip the scan.
    needs_digit: bool = False
    # How far before a match a context word may stand.
    context_chars: int = CONTEXT_WINDOW_CHARS


def _custom() -> list[Recognizer]:
    return [Recognizer(t, p, s, tuple(ctx), needs_digit=True) for t, p, s, ctx in vocab.CUSTOM_RECOGNIZERS]


# Structural recognisers (pattern + checksum), in priority order.
STRUCTURAL = [
    Recognizer("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0, requires="@"),
    Recognizer("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", 1.0,
               validator=checks.iban_valid, needs_digit=True),
    Recognizer("CREDIT_CARD",
               r"\b(?:4[0-9]{3}|5[0-5][0-9]{2}|6[0-9]{3}|1[0-9]{3}|3[0-9]{3})[- ]?[0-9]{3,4}[- ]?[0-9]{3,4}[- ]?[0-9]{3,5}\b",
               1.0, validator=checks.luhn_valid, needs_digit=True),
    Recognizer("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", 0.95,
               validator=checks.ipv4_valid, needs_digit=True),
    Recognizer("PHONE_NUMBER",
               r"(?:\+[0-9]{1,3} ?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ -][0-9]{3,4}[ -]?[0-9]{3,4}\b", 0.75, needs_digit=True),
    Recognizer("URL",
               r"\b(?:https?://)?(?:www\.)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:com|org|net|edu|gov|io|eu|it|de|fr|ch|uk)\b(?:/[^\s<>\"]*)?",
               0.6),
    Recognizer("DATE_TIME",
               r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}\b|\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
               0.85, needs_digit=True),
    Recognizer("MEDICAL_LICENSE", r"\b[ABCDEFGHJKMPRSTUX][A-Z][0-9]{7}\b", 0.4,
               validator=checks.dea_valid, needs_digit=True),
    Recognizer("CRYPTO", r"\b(?:bc1|[13])[a-km-zA-HJ-NP-Z1-9]{25,39}\b", 0.5, needs_digit=True),
    Recognizer("NRP", r"\b[A-Z]{6}[0-9]{2}[A-EHLMPR-T][0-9]{2}[A-Z][0-9]{3}[A-Z]\b", 0.7, needs_digit=True),
] + _custom()

# Rule recognisers standing in for a statistical NER model (persons,
# organisations, locations).  The value is the last capture group.
_UP = r"\p{Lu}[\p{Ll}'’-]+"
# Java 17 and RE2 disagree on \b next to non-ASCII letters, so the rule
# recognisers anchor on an explicit non-letter (or line start) instead.
_START = r"(?:^|[^\p{L}\p{N}_])"
SEMANTIC = [
    Recognizer("PERSON",
               r"(?:Nome|Name|Nom|Vorname|Sig\.(?:ra)?|Dott\.(?:ssa)?|Dr\.|Mr\.|Mrs\.|Ms\.|Mme|Herr|Frau)"
               r"[ \t]*:?[ \t]*(" + _UP + r"(?:[ \t]+" + _UP + r"){1,2})", 0.85, group=1),
    Recognizer("PERSON", _START + r"(" + _UP + r"[ \t]+" + _UP + r")", 0.6, group=1),
    Recognizer("ORGANIZATION",
               _START + r"(" + _UP + r"(?:[ \t]+" + _UP + r")*[ \t]+(?:S\.r\.l\.|S\.p\.A\.|GmbH|AG|SA|Sagl|Ltd|Inc\.|LLC))",
               0.85, group=1),
    Recognizer("LOCATION",
               _START + r"((?:Via|Viale|Piazza|Corso|Rue|Avenue|Street|Road)[ \t]+(?:" + _UP + r"[ \t]+){1,3}[0-9]{1,4})",
               0.85, group=1, needs_digit=True),
]

DEFAULT_RECOGNIZERS = STRUCTURAL + SEMANTIC


def _offsets(text: Column, pattern: str, matches: Column) -> Column:
    """0-based start offset of each match: split the text on the pattern; the
    i-th match starts after gaps 0..i and matches 0..i-1 (D1).  One pass that
    carries the running position."""
    gaps = F.split(text, pattern, -1)
    z = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"))
    acc = F.aggregate(
        z, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct(
            (a["pos"] + F.length(x["g"]) + F.length(x["m"])).alias("pos"),
            F.array_append(a["out"], a["pos"] + F.length(x["g"])).alias("out")))
    return acc["out"]


def context_hit(text: Column, start: Column, words: tuple, chars: int = CONTEXT_WINDOW_CHARS) -> Column:
    """True when a context word (case-insensitive) occurs in the ``chars``
    characters before ``start`` (0-based)."""
    lo = F.greatest(start - chars, F.lit(0))
    prefix = F.lower(F.substring(text, lo + 1, start - lo))
    return let(prefix, lambda p: F.exists(dims.array_lit([w.lower() for w in words]), lambda w: F.instr(p, w) > 0))


def _to_struct(text: Column, r: Recognizer, rank: int):
    def f(x, i):
        return F.struct(
            F.instr(text, x["v"]).alias("first"),
            F.lit(rank).alias("rank"),
            i.alias("occ"),
            x["s"].alias("start"),
            x["v"].alias("value"),
            F.lit(r.detector_type).alias("detector_type"),
            F.lit(float(r.score)).alias("score"),
        )
    return f


def _validate(r: Recognizer):
    return lambda e: r.validator(e["value"])


def _boost(text: Column, r: Recognizer):
    def f(e):
        return e.withField(
            "score",
            F.when(context_hit(text, e["start"], r.context, r.context_chars),
                   F.least(e["score"] + F.lit(vocab.CONTEXT_BOOST), F.lit(1.0)))
            .otherwise(e["score"]))
    return f


def unconfirmed_safe() -> list[Recognizer]:
    """Recognisers whose hits survive the merge when no model output confirms
    them: person, organisation and place hits need a confirmation."""
    types = {t: e for t, _, e in vocab.DETECTOR_TYPE_MAP}
    return [r for r in DEFAULT_RECOGNIZERS if types.get(r.detector_type) not in vocab.SEMANTIC_MERGE_TYPES]


def extractions(text: Column, recognizers: list[Recognizer]) -> dict[str, Column]:
    """Matches per recogniser as columns, for ``match_array`` to read several
    times: projected first, each pattern runs over a text once."""
    empty = F.array().cast("array<string>")
    out = {}
    for i, r in enumerate(recognizers):
        found = {f"_values_{i}": r.group}
        if r.context and r.group:
            found[f"_whole_{i}"] = 0
        for name, group in found.items():
            vals = F.regexp_extract_all(text, F.lit(r.pattern), group)
            if r.requires:
                vals = F.when(F.instr(text, r.requires) > 0, vals).otherwise(empty)
            if r.needs_digit:
                # most prose has no digit at all; those rows skip the pattern
                vals = F.when(text.rlike("[0-9]"), vals).otherwise(empty)
            out[name] = vals
    return out


def match_array(text: Column, recognizers: list[Recognizer] = None, projected: bool = False) -> Column:
    """One array<struct<first, rank, occ, start, value, detector_type, score>>
    per row; ``first`` is the 1-based position of the value's first
    occurrence, the detection-order key.  ``start`` (0-based match offset) is
    only computed for recognisers with context words.  ``projected``: the row
    has the columns of ``extractions``."""
    recognizers = recognizers or DEFAULT_RECOGNIZERS
    found = extractions(text, recognizers)
    if projected:
        found = {name: F.col(name) for name in found}
    parts = []
    for rank, r in enumerate(recognizers):
        vals = found[f"_values_{rank}"]
        if r.context:
            whole = found.get(f"_whole_{rank}", vals)
            starts = F.when(F.size(vals) > 0, _offsets(text, r.pattern, whole)) \
                      .otherwise(F.array().cast("array<int>"))
            starts = F.zip_with(starts, F.zip_with(whole, vals, lambda m, v: F.length(m) - F.length(v)),
                                lambda s0, d: s0 + d)
            z = F.arrays_zip(vals.alias("v"), starts.alias("s"))
        else:
            z = F.transform(vals, lambda v: F.struct(v.alias("v"), F.lit(None).cast("int").alias("s")))
        arr = F.transform(z, _to_struct(text, r, rank))
        if r.validator is not None:
            arr = F.filter(arr, _validate(r))
        if r.context:
            arr = F.transform(arr, _boost(text, r))
        parts.append(arr)
    return F.concat(*parts) if len(parts) > 1 else parts[0]
