"""The extract run as one nested record a document.

``extract`` is the whole pipeline of ``operators.record`` with its result: the
language it detected, the document's type, the entities with their roles and
proposed placeholders.  A document whose model call failed stays a row, with
``status`` error and no entities.  ``run_records`` adds the redaction, in the
layout the run files have (``sources.io.RUN_RECORD_SCHEMA``).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import vocab
from . import record as RC
from . import redact as X

NO_MODEL_OUTPUT = "no model output"


def extract(docs: DataFrame, model_outputs: DataFrame, categories=None, lang_col: str | None = None, override_col: str | None = None,
            text_col: str = "content", recognizers=None, partitions: int | None = None) -> DataFrame:
    """One row a document: the columns of ``docs``, ``status``, ``error``,
    ``doc_language`` (detected unless ``lang_col`` names it), ``doc_type`` (or the
    valid one of ``override_col``), ``categories_requested``, ``ents``
    (array<struct<seq, value, category, entity_type, semantic_role>>) and
    ``extracted``: the entities as the result holds them, null after an error.

    Two shuffles, of the documents and of the model's outputs.  A document
    without any entity output, and one whose call left an error, are errors; an
    output that doesn't parse is an empty one.  A null text has no entities.
    ``partitions`` as in ``record.assemble``.
    """
    rows = RC.with_roles(RC.identified(RC.judge(RC.assemble(docs, model_outputs, categories, text_col, lang_col, recognizers, partitions)), text_col), text_col, override_col)
    error = F.when(F.col("model_error").isNotNull() & ~F.coalesce("model_ok", F.lit(False)), F.col("model_error")).when(F.col("model_ok").isNull(), F.lit(NO_MODEL_OUTPUT))
    rows = rows.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("error")))
    rows = rows.withColumn("ents", F.when(F.col("error").isNull(), RC.packed_entities(F.col("entities"))))
    shown = X.proposed_replacements(F.col("ents"), F.col("doc_language"))
    kept = F.filter("entities", lambda x: x["keep"])
    result = RC.let(F.struct(kept.alias("kept"), shown.alias("shown")), lambda r: F.transform(r["kept"], lambda x, i: F.struct(
        x["e"]["value"].alias("value"), x["e"]["category"].alias("category"), x["e"]["entity_type"].alias("entity_type"),
        x["e"]["confidence"].alias("confidence"), x["e"]["source"].alias("source"), x["role"].alias("semantic_role"),
        F.get(r["shown"], i).alias("proposed_replacement"))))
    wanted = F.array(*[F.lit(c) for c in (categories or vocab.CATEGORIES)])
    out = rows.withColumn("extracted", F.when(F.col("error").isNull(), result)).withColumn("categories_requested", wanted)
    return out.select(*docs.columns, "status", "error", "doc_language", "doc_type", "categories_requested", "ents", "extracted")


def run_records(extracted: DataFrame, run_id: str, timestamp: str, model: str, name: Column, text_col: str = "content", isolate: bool = False) -> DataFrame:
    """V5: a run record a document, from ``extract``.

    Times are no columns: ``processing_time_ms`` is null, the run's own table has
    them per stage (``timed_stages``).  The preview is the first 600 characters."""
    text = F.when(F.col("error").isNull(), F.coalesce(text_col, F.lit("")))
    rows = X.anonymize_packed(extracted.withColumn("_text", text), "ents", "_text", "doc_language", isolate=isolate)
    no_time = F.lit(None).cast("bigint").alias("processing_time_ms")
    done = F.col("error").isNull()
    extraction = F.struct(F.size("extracted").cast("bigint").alias("entities_count"), no_time, "categories_requested", F.col("extracted").alias("entities"))
    mappings = F.transform("mappings", lambda m: F.struct(*[m[c].alias(c) for c in ("original", "replacement", "category", "entity_type", "semantic_role")]))
    redacted = F.struct(F.size("mappings").cast("bigint").alias("mappings_count"), no_time, mappings.alias("mappings"),
                        F.substring("anonymized", 1, vocab.PREVIEW_CHARS).alias("anonymized_preview"))
    return rows.select(
        F.lit(run_id).alias("run_id"), F.lit(timestamp).alias("timestamp"), name.alias("document"), F.col("doc_id").cast("string").alias("document_id"),
        F.lit(model).alias("model"), F.length(F.coalesce(text_col, F.lit(""))).cast("bigint").alias("char_count"), "status",
        F.when(done, extraction).alias("extraction"), F.when(done, redacted).alias("anonymization"), "error")


def timed_stages(stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], docs: DataFrame, run_id: str, write: Callable[[DataFrame, str], DataFrame],
                 text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Run ``stages`` one after the other, each written by ``write(df, name)``
    and read back, and record a row a stage: run_id, stage, documents, characters,
    elapsed_ms, chars_per_second.

    The counts are observed while the stage is written, so nothing is read twice.
    A stage's result without the text column counts no characters."""
    metrics, rows = [], docs
    for name, stage in stages:
        seen = Observation(f"{run_id}-{name}")
        out = stage(rows)
        chars = F.sum(F.length(text_col)) if text_col in out.columns else F.sum(F.lit(0))
        began = time.monotonic()
        rows = write(out.observe(seen, F.count(F.lit(1)).alias("documents"), F.coalesce(chars, F.lit(0)).alias("characters")), name)
        elapsed = int((time.monotonic() - began) * 1000)
        got = seen.get
        metrics.append((run_id, name, got["documents"], got["characters"], elapsed, round(got["characters"] * 1000 / max(elapsed, 1), 1)))
    table = docs.sparkSession.createDataFrame(metrics, "run_id string, stage string, documents long, characters long, elapsed_ms long, chars_per_second double")
    return rows, table
