"""Precision / recall evaluation against annotations (T3, T4, D-20 ... D-22, G6, G7).

Predictions and truth are ``(doc_id, value, category)`` rows.  Matching is a
join on ``(doc_id, normalised value[, category])``; the report is one
GROUPING SETS aggregate (category, language, document, overall) with the
six categories zero-filled.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import vocab


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def _trimmed(value: Column) -> Column:
    chars = vocab.EVAL_TRIM_CHARS
    cls = "".join("\\" + ch if ch in "\\^-[]" else ch for ch in chars)
    return F.regexp_replace(F.lower(F.regexp_replace(value, f"^[{cls}]+|[{cls}]+$", "")), r"\s+", " ")


def normal_form(value: Column) -> Column:
    """NFKC, strip the fixed punctuation/whitespace set, lower-case, collapse
    whitespace runs.  ASCII values are their own NFKC form: only values with other
    characters are sent to the Python worker, the rest as nulls."""
    return _trimmed(F.coalesce(_nfkc(F.when(value.rlike(r"[^\x00-\x7F]"), value)), value))


def language_from_name(filename: Column) -> Column:
    """T4: language code from the file-name suffix (DECH counts as DE)."""
    stem = F.regexp_replace(filename, r"\.[^./]*$", "")
    out = F.lit("??")
    for lang in reversed(vocab.EVAL_LANG_SUFFIXES):
        out = F.when(stem.endswith("_" + lang), F.lit("DE" if lang == "DECH" else lang)).otherwise(out)
    return out


def _norm_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull()).select("doc_id", normal_form(F.col("value")).alias("v"), "category")


def _norm_set(df: DataFrame) -> DataFrame:
    return _norm_rows(df).distinct()


def strict_counts(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """D-20: (doc, category) tp/fp/fn over the distinct (value, category)
    sets -- a full outer join; a wrong category is both fp and fn."""
    p = _norm_set(pred).withColumn("in_p", F.lit(1))
    t = _norm_set(truth).withColumn("in_t", F.lit(1))
    j = p.join(t, ["doc_id", "v", "category"], "full_outer")
    return j.groupBy("doc_id", "category").agg(
        F.count_if(F.col("in_p").isNotNull() & F.col("in_t").isNotNull()).alias("tp"),
        F.count_if(F.col("in_p").isNotNull() & F.col("in_t").isNull()).alias("fp"),
        F.count_if(F.col("in_p").isNull() & F.col("in_t").isNotNull()).alias("fn"))


def lenient_counts(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """D-21: category ignored for matching.  Each predicted (value, category)
    is tp if the value is annotated at all, else fp; each annotated
    (value, category) whose value was never predicted is fn.

    Both sides are read once: a value of a document is one group with the
    categories each side gives it.  Rows without a document match nothing, and
    counts of a null document or category stay apart by side."""
    both = _norm_rows(pred).withColumn("predicted", F.lit(True)).unionByName(_norm_rows(truth).withColumn("predicted", F.lit(False)))
    side = F.when(F.col("doc_id").isNull(), F.col("predicted"))
    given = lambda test: F.collect_set(F.when(test, F.struct("category")))
    by_value = both.groupBy("doc_id", "v", side.alias("side")).agg(given(F.col("predicted")).alias("p"), given(~F.col("predicted")).alias("t"))
    counted = lambda found, kind: F.transform(found, lambda c: F.struct(c["category"].alias("category"), kind.alias("kind")))
    hit = F.when(F.size("t") > 0, F.lit("tp")).otherwise(F.lit("fp"))
    rows = by_value.select("doc_id", F.explode_outer(F.when(F.size("p") > 0, counted(F.col("p"), hit)).otherwise(counted(F.col("t"), F.lit("fn")))).alias("c"))
    apart = F.when(F.col("doc_id").isNull() | F.col("c.category").isNull(), F.col("c.kind") == "fn")
    of = lambda kind: F.count_if(F.col("c.kind") == kind).alias(kind)
    return rows.groupBy("doc_id", F.col("c.category").alias("category"), apart.alias("apart")).agg(of("tp"), of("fp"), of("fn")).drop("apart")


def evaluable(pred: DataFrame, truth: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """D-22: predictions and truth of the documents that are evaluated: those
    annotated (a row of ``truth``, with a null value where nothing is annotated)
    and, when run records are given, whose run succeeded.  A document that is
    skipped leaves both sides, so its truth is no miss."""
    keep = truth.select("doc_id").distinct()
    if runs is None:
        return pred.join(keep, "doc_id", "left_semi"), truth
    keep = keep.join(runs.where(F.col("status") == "success").select("doc_id").distinct(), "doc_id", "left_semi")
    return pred.join(keep, "doc_id", "left_semi"), truth.join(keep, "doc_id", "left_semi")


def skipped(docs: DataFrame, truth: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """D-22: (doc_id, reason) of the documents that are not evaluated."""
    out = docs.select("doc_id").join(truth.select("doc_id").distinct().withColumn("annotated", F.lit(True)), "doc_id", "left")
    if runs is not None:
        state = runs.groupBy("doc_id").agg(F.max((F.col("status") == "success").cast("int")).alias("ok"))
        out = out.join(state, "doc_id", "left")
    else:
        out = out.withColumn("ok", F.lit(1))
    reason = (F.when(F.col("annotated").isNull(), F.lit("no annotation")).when(F.col("ok").isNull(), F.lit("not run"))
               .when(F.col("ok") == 0, F.lit("run failed")))
    return out.select("doc_id", reason.alias("reason")).where("reason is not null")


def prf(tp: Column, fp: Column, fn: Column):
    """Precision, recall, F1 with 0 for an undefined ratio."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return p, r, f


def report(spark: SparkSession, counts: DataFrame, doc_lang: DataFrame) -> DataFrame:
    """tp/fp/fn and P/R/F1 by category, language, document and overall.
    ``counts`` is (doc_id, category, tp, fp, fn); ``doc_lang`` (doc_id, lang).
    Every evaluated document is zero-filled over the six categories."""
    # zero-fill: a document's counts as one row, then the six fixed categories of it
    own = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("tp", "fp", "fn")))).alias("own"))
    grid = own.join(doc_lang, "doc_id", "left").select("doc_id", "lang", "own", F.explode(F.array(*[F.lit(c) for c in vocab.CATEGORIES])).alias("category"))
    got = F.try_element_at("own", F.col("category"))
    full = grid.select("doc_id", "lang", "category", *[F.coalesce(got[c], F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    agg = full.groupingSets([["category"], ["lang"], ["doc_id"], []], "category", "lang", "doc_id").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.grouping("category").alias("gc"), F.grouping("lang").alias("gl"), F.grouping("doc_id").alias("gd"))
    kind = (F.when(F.col("gc") == 0, F.lit("category")).when(F.col("gl") == 0, F.lit("language"))
             .when(F.col("gd") == 0, F.lit("document")).otherwise(F.lit("total")))
    grp = F.coalesce(F.col("category"), F.col("lang"), F.col("doc_id").cast("string"), F.lit("all"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select(kind.alias("grouping"), grp.alias("grp"), F.col("tp").cast("bigint").alias("tp"),
                      F.col("fp").cast("bigint").alias("fp"), F.col("fn").cast("bigint").alias("fn"),
                      F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


# The report's parts in the order they are printed.
REPORT_ORDER = ["document", "language", "category", "total"]


def sorted_report(rows: DataFrame) -> DataFrame:
    """S3: the report's rows by part; documents and languages by name, categories
    in their fixed order.  A range sort over all partitions."""
    part = F.array_position(F.array(*[F.lit(p) for p in REPORT_ORDER]), F.col("grouping"))
    place = F.when(F.col("grouping") == "category", F.array_position(F.array(*[F.lit(c) for c in vocab.CATEGORIES]), F.col("grp")))
    return rows.orderBy(part, place, "grp")
