"""Fixed vocabularies (``vocab.py``) as map literals and tiny dimension tables.

Lookups of a few dozen fixed entries are done with literal ``map`` columns:
the map lives in the generated code, so there is no join, no broadcast and
no shuffle.  ``dimension()`` builds a DataFrame for the cases where a join
reads better (zero-filling counts over the six categories).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def map_lit(pairs) -> Column:
    """A literal map column from (key, value) pairs of strings, or of a string and a
    list of strings; one expression, so that building it is one call of the JVM."""
    shown = lambda v: _quoted(v) if isinstance(v, str) else "array(" + ", ".join(map(_quoted, v)) + ")"
    return F.expr("map(" + ", ".join(f"{_quoted(k)}, {shown(v)}" for k, v in pairs) + ")")


def array_lit(values) -> Column:
    return F.expr("array(" + ", ".join(map(_quoted, values)) + ")")


def detector_category() -> Column:
    return map_lit([(t, c) for t, c, _ in vocab.DETECTOR_TYPE_MAP])


def detector_entity_type() -> Column:
    return map_lit([(t, e) for t, _, e in vocab.DETECTOR_TYPE_MAP])


def deny_terms_for(lang: Column, after: str = "") -> Column:
    """Deny-list terms for the common bucket plus ``lang``'s bucket, each with ``after`` behind it."""
    common = vocab.DENY_LIST["common"]
    listed = lambda terms: [t + after for t in terms]
    per_lang = map_lit([(of, listed(common + terms)) for of, terms in vocab.DENY_LIST.items() if of != "common"])
    return F.coalesce(per_lang[lang], array_lit(listed(common)))


def type_aliases() -> Column:
    return map_lit(vocab.TYPE_ALIASES)


def role_constraint_key(doc_type: Column, role: Column) -> Column:
    return F.concat_ws("|", doc_type, role)


def role_constraints() -> Column:
    return map_lit([(f"{d}|{r}", t) for d, r, t in vocab.ROLE_CONSTRAINTS])


def categories_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in vocab.CATEGORIES], "category string")
