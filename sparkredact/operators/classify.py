"""Per-document classification: language (C19) and document type.

Both are narrow per-row expressions over the text -- no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.binding import let

# Stop-word profiles used to score the language of a text.  The reference
# detects Italian, English, French and German (default Italian); the profile
# set is a parameter of ``detect_language``.
STOPWORDS = {
    "it": ["il", "lo", "la", "gli", "di", "che", "e", "per", "non", "con", "del", "della", "sono"],
    "en": ["the", "and", "of", "to", "is", "that", "it", "with", "for", "as", "was", "on", "this"],
    "fr": ["le", "les", "des", "et", "est", "une", "du", "que", "dans", "pour", "avec", "sur", "qui"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "den", "ein", "eine", "zu", "von", "auf"],
}
TOKEN_SPLIT = r"[^\p{L}]+"


def detect_language(text: Column, profiles: dict | None = None,
                    default: str = vocab.DEFAULT_LANGUAGE) -> Column:
    """The language whose stop words occur most often among the tokens;
    ties go to the smaller language code; no hit at all -> ``default``."""
    profiles = profiles or STOPWORDS
    scores = lambda toks: F.array(*[
        F.struct((-F.size(F.filter(toks, _in_list(words)))).alias("neg"), F.lit(lang).alias("lang"))
        for lang, words in sorted(profiles.items())])
    best = let(F.split(F.lower(text), TOKEN_SPLIT, -1), lambda toks: F.array_min(scores(toks)))
    return F.coalesce(let(best, lambda b: F.when(b["neg"] < 0, b["lang"])), F.lit(default))


def _in_list(words):
    return lambda t: t.isin(words)


def detect_doc_type(text: Column) -> Column:
    """C20: first matching pattern family on the first 800 characters."""
    head = F.substring(text, 1, vocab.DOC_TYPE_HEAD_CHARS)
    out = F.lit(None).cast("string")
    for kind, pat in reversed(vocab.DOC_TYPE_PATTERNS):
        out = F.when(head.rlike("(?iu)" + pat), F.lit(kind)).otherwise(out)
    return out


def effective_doc_type(override: Column, detected: Column) -> Column:
    """A valid override wins, else the detected type."""
    return F.when(override.isin(vocab.DOC_TYPES), override).otherwise(detected)


def classify(docs: DataFrame, text_col: str = "content") -> DataFrame:
    return (docs.withColumn("detected_language", detect_language(F.col(text_col)))
                .withColumn("doc_type", detect_doc_type(F.col(text_col))))
