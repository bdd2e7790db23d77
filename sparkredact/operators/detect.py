"""Pattern detection (C1-C17) and the detector post-filters.

Two shapes:

* ``detect_packed`` adds one ``detected`` array column per document -- the
  whole detector runs inside the scan's task (no shuffle).
* ``detect`` explodes it to entity rows ``(doc_id, seq, value, category,
  entity_type, confidence, source)``.
"""

from __future__ import annotations

from typing import Callable, Iterable, Iterator, Optional

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims, vocab
from ..functions import recognizers as R
from ..functions.binding import built_once, let
from ..functions.text import clean_span, rstrip_chars, ustrip

ENTITY_STRUCT = ("seq", "value", "category", "entity_type", "confidence", "source")


def effective_language(lang: Column) -> Column:
    """The detected language if a rule profile exists, else the default."""
    return F.when(lang.isin(vocab.DETECTOR_LANGUAGES), lang).otherwise(F.lit(vocab.DEFAULT_LANGUAGE))


def _fp_fields(value: Column) -> dict:
    stripped = ustrip(value)
    lowered = F.lower(stripped)
    first_line = ustrip(rstrip_chars(ustrip(F.substring_index(lowered, "\n", 1)), ":–—-"))
    return {"stripped": stripped, "lowered": lowered, "first_line": first_line}


def _fp_test(stripped: Column, lowered: Column, first_line: Column, detector_type: Column, lang: Column) -> Column:
    terms = dims.deny_terms_for(lang)
    deny = (F.array_contains(terms, lowered)
            | F.array_contains(terms, first_line)
            | F.exists(dims.deny_terms_for(lang, " "), lambda t: lowered.startswith(t)))
    partial_iban = (stripped.rlike(vocab.PARTIAL_IBAN_PATTERN)
                    & (F.length(F.replace(stripped, F.lit(" "), F.lit(""))) < vocab.IBAN_MIN_LEN_NO_SPACES))
    return detector_type.isin(vocab.SEMANTIC_DETECTOR_TYPES) & (deny | partial_iban)


def is_semantic_false_positive(value: Column, detector_type: Column, lang: Column) -> Column:
    """B5 layers 1-2: deny-list (exact, first line, ``term + ' '`` prefix) and
    partial-IBAN fragment, only for statistical detector types.  (``value``
    should be a plain column: the prefix test references it per deny term.)"""
    f = _fp_fields(value)
    return _fp_test(f["stripped"], f["lowered"], f["first_line"], detector_type, lang)


def detected_array(text: Column, lang: Column,
                   categories: Optional[Iterable[str]] = None,
                   recognizers=None, projected: bool = False) -> Column:
    """Array of detected entities for one document, in detection order."""
    raw = F.array_sort(R.match_array(text, recognizers, projected))   # by (first occurrence, rank, occ)
    cat_map, type_map = dims.detector_category(), dims.detector_entity_type()

    def typed(e, i, value):
        # A PERSON that is a fiscal code once it is clean is re-typed before mapping
        kind = F.when((e["detector_type"] == "PERSON") & value.rlike(vocab.FISCAL_CODE_PATTERN), F.lit("NRP")).otherwise(e["detector_type"])
        return let(F.struct(value.alias("value"), kind.alias("kind")), lambda x: F.struct(
            (i + 1).alias("seq"), x["value"],
            cat_map[x["kind"]].alias("category"),
            type_map[x["kind"]].alias("entity_type"),
            e["score"].alias("confidence"), F.lit("ner").alias("source"),
            x["kind"].alias("detector_type"),
            # computed once per element: the deny-list lambda below reads them per term
            *[F.when(x["kind"].isin(vocab.SEMANTIC_DETECTOR_TYPES), c).alias(k) for k, c in _fp_fields(x["value"]).items()],
        ))

    ent = F.transform(raw, lambda e, i: let(clean_span(e["value"]), lambda value: typed(e, i, value)))
    allowed = list(categories) if categories else []

    def keep(e):
        ok = (F.length(e["value"]) > 0) & e["category"].isNotNull()
        if allowed:
            ok = ok & e["category"].isin(allowed)                    # B1
        ok = ok & ~_fp_test(e["stripped"], e["lowered"], e["first_line"], e["detector_type"], lang)   # B5
        ok = ok & ~((e["detector_type"] == "DATE_TIME")
                    & ~e["value"].rlike(vocab.SPECIFIC_DATE_PATTERN))                # B6
        ok = ok & ~((e["detector_type"] == "NRP")
                    & ~e["value"].rlike(vocab.FISCAL_CODE_PATTERN))                  # B7
        return ok

    ent = F.filter(ent, keep)
    return F.transform(ent, lambda e: F.struct(*[e[k].alias(k) for k in ENTITY_STRUCT]))


@built_once
def _detector(text_col: str, lang_col: str, categories: tuple, recognizers: tuple) -> tuple[dict, Column]:
    """The detector's expressions over two column names."""
    text = F.col(text_col)
    return R.extractions(text, list(recognizers)), detected_array(text, F.col(lang_col), categories, list(recognizers), projected=True)


def detect_packed(docs: DataFrame, text_col: str = "content", lang_col: str = "language",
                  categories=None, recognizers=None, out_col: str = "detected") -> DataFrame:
    found, detected = _detector(text_col, lang_col, tuple(categories or ()), tuple(recognizers or R.DEFAULT_RECOGNIZERS))
    return docs.withColumns(found).withColumn(out_col, detected).drop(*found)


def explode_outer_nonnull(df: DataFrame, array_col: str, keep, alias: str = "e") -> DataFrame:
    """Explode an array column without letting the optimizer infer a
    ``size(array) > 0`` filter: for an inner explode Catalyst pushes that filter
    below the projection that builds the array, which evaluates the whole
    array expression (here: every regex over the text) twice."""
    return (df.select(*keep, F.explode_outer(array_col).alias(alias))
              .where(F.col(alias).isNotNull()))


def explode_entities(df: DataFrame, array_col: str, keep=("doc_id",)) -> DataFrame:
    return (explode_outer_nonnull(df, array_col, keep)
            .select(*keep, *[F.col("e")[k].alias(k) for k in ENTITY_STRUCT]))


def detect(docs: DataFrame, text_col: str = "content", lang_col: str = "language",
           categories=None, recognizers=None, keep_fn=None) -> DataFrame:
    """Entity rows from the pattern detector (C1 + B1-B8).

    ``keep_fn`` is the third layer of B5, see ``keep_by``."""
    packed = detect_packed(docs.select("doc_id", text_col, lang_col), text_col, lang_col,
                           categories, recognizers)
    if keep_fn is None:
        return explode_entities(packed, "detected")
    return keep_by(explode_entities(packed, "detected", ("doc_id", lang_col)), keep_fn, lang_col).drop(lang_col)


def keep_by(entities: DataFrame, keep_fn: Callable, lang_col: str = "language") -> DataFrame:
    """B5 layer 3: entities of the semantic types pass the user's own test.

    ``keep_fn(values, entity_types, languages)`` takes three pandas Series and
    returns booleans; it runs after every cheap filter and once per distinct
    (value, entity_type, language), not per entity.  The verdicts are joined back;
    a null verdict, or a null language's, keeps.  The function must judge a value
    alike wherever it runs."""
    keys = ["value", "entity_type", "_lang"]
    semantic = F.col("entity_type").isin(vocab.SEMANTIC_MERGE_TYPES)
    rows = entities.withColumn("_lang", F.coalesce(F.col(lang_col), F.lit("")))

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            verdict = pd.Series(keep_fn(part["value"], part["entity_type"], part["_lang"])).reset_index(drop=True)
            yield part.reset_index(drop=True)[verdict.eq(False).fillna(False).astype(bool)]

    rejected = rows.where(semantic).select(*keys).distinct().mapInPandas(judge, "value string, entity_type string, _lang string")
    return rows.join(rejected, keys, "left_anti").select(*entities.columns)


def dedup_detected_array(arr: Column) -> Column:
    """G1 on a packed array: per (lower(value), entity_type) keep the highest
    confidence (null = 0; first on ties) at the key's first position.

    Sort by (key, -confidence, seq) so each key's winner comes first, fold once
    keeping the winner and the key's smallest seq, then restore seq order.
    Lambdas only touch their own variables: Spark re-evaluates any outer
    expression referenced inside a lambda once per element.
    """
    keyed = F.array_sort(F.transform(arr, lambda e: F.struct(
        F.concat_ws("\u0001", F.lower(e["value"]), e["entity_type"]).alias("k"),
        (-F.coalesce(e["confidence"], F.lit(0.0))).alias("neg_conf"),
        e["seq"].alias("seq"), e.alias("e"))))
    init = F.struct(F.lit(None).cast("string").alias("k"),
                    F.slice(F.transform(arr, lambda e: e), 1, 0).alias("out"))

    def step(acc, x):
        last = F.element_at(acc["out"], -1)
        same = acc["k"].isNotNull() & (acc["k"] == x["k"])
        return F.struct(
            x["k"].alias("k"),
            F.when(same, F.array_append(F.slice(acc["out"], 1, F.size(acc["out"]) - 1),
                                        last.withField("seq", F.least(last["seq"], x["seq"]))))
            .otherwise(F.array_append(acc["out"], x["e"])).alias("out"))

    folded = F.aggregate(keyed, init, step)["out"]
    return F.transform(F.array_sort(F.transform(folded, lambda e: F.struct(e["seq"].alias("s"), e.alias("e")))),
                       lambda x: x["e"])
