"""String helpers with Python-compatible semantics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

# Unicode's White_Space, as ``(?U)\s`` in a pattern.
WHITESPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def ustrip(c: Column) -> Column:
    """Python ``str.strip()``: all Unicode whitespace, both ends (Spark's trim
    alone only removes U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_chars(c: Column, chars: str) -> Column:
    """Python ``str.strip(chars)`` for a literal character set."""
    return F.btrim(c, F.lit(chars))


def rstrip_chars(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def quote_regex(c: Column) -> Column:
    """Quote a column value for use inside a Java regex (\\Q..\\E, with any
    embedded \\E split out)."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def clean_span(value: Column) -> Column:
    """Detector span clean-up: strip, then drop trailing whitespace and
    markdown punctuation (``- * | — – :``)."""
    return rstrip_chars(ustrip(value), WHITESPACE + "-*|—–:")


_FIELD_LABEL_RE = (r"(?iU)\s+(?:-\s+)?(?:" + "|".join(vocab.FIELD_LABELS) + r")\b")


def clean_model_value(raw: Column) -> Column:
    """Clean a model-extracted value, in this exact order:
    1. drop the first newline run and everything after it
    2. cut at the first `` - `` bullet followed by a non-space
    3. cut at an embedded field label unless it is at position 0
    4. strip; strip ``-*_#``; strip; drop trailing ``:``; strip
    """
    v = F.regexp_replace(raw, r"(?s)[\n\r]+.*", "")
    # split at first \s+-\s+ that is followed by a non-space character
    cut = F.regexp_extract(v, r"(?s)^(.*?)\s+-\s+\S", 1)
    has_cut = (F.instr(v, "-") > 0) & v.rlike(r"(?s)\s+-\s+\S")
    v = F.when(has_cut, cut).otherwise(v)
    pos = F.regexp_instr(v, F.lit(_FIELD_LABEL_RE))
    v = F.when(pos > 1, F.substring(v, F.lit(1), pos - 1)).otherwise(v)
    v = ustrip(v)
    v = strip_chars(v, "-*_#")
    v = ustrip(v)
    v = rstrip_chars(v, ":")
    return ustrip(v)
