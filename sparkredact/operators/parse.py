"""Model-output parsing (J1-J3) and value clean-up.

Model outputs are an input table ``model_outputs(doc_id, stage, raw)``; parsing
is ``from_json`` with a declared schema, so malformed, truncated or
single-quoted text yields no rows instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims, vocab
from ..functions.text import clean_model_value, ustrip

ENTITIES_SCHEMA = T.StructType([T.StructField("entities", T.ArrayType(T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("entity_type", T.StringType()),
])))])
ASSIGNMENTS_SCHEMA = T.StructType([T.StructField("assignments", T.ArrayType(T.StructType([
    T.StructField("value", T.StringType()), T.StructField("role", T.StringType())])))])
OWNERSHIP_SCHEMA = T.StructType([T.StructField("ownership", T.ArrayType(T.StructType([
    T.StructField("value", T.StringType()), T.StructField("owner_role", T.StringType())])))])

_JSON_OPTS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def json_payload(raw: Column) -> Column:
    """Strip code fences, then take the outermost ``{...}`` (greedy, dotall)."""
    cleaned = ustrip(F.regexp_replace(raw, r"```[a-z]*\n?", ""))
    return F.regexp_extract(cleaned, r"(?s)\{.*\}", 0)


def _parse(model_outputs: DataFrame, stage: str, schema, field: str) -> DataFrame:
    payload = json_payload(F.col("raw"))
    parsed = (model_outputs.where(F.col("stage") == stage)
              .select("doc_id", F.from_json(payload, schema, _JSON_OPTS)[field].alias("items")))
    # outer explode: an inner one makes Catalyst push a size() filter below
    # the projection and parse every payload twice
    return (parsed.select("doc_id", F.posexplode_outer("items").alias("pos", "it"))
            .where(F.col("it").isNotNull()))


def model_items(model_outputs: DataFrame) -> DataFrame:
    """Raw entity items: doc_id, pos (0-based list position), raw_value,
    category, raw_type."""
    items = _parse(model_outputs, "entities", ENTITIES_SCHEMA, "entities")
    return items.select("doc_id", F.col("pos").cast("int").alias("pos"),
                        F.col("it.value").alias("raw_value"), F.col("it.category").alias("category"),
                        F.col("it.entity_type").alias("raw_type"))


def reject_reason(value: Column) -> Column:
    """Why a cleaned value is rejected (NULL = kept)."""
    return (F.when(value.isNull() | (F.length(value) == 0), F.lit("empty"))
            .when(F.length(value) > vocab.MAX_VALUE_LENGTH, F.lit("too_long"))
            .when((F.instr(value, "@") > 0) & (F.instr(value, "|") > 0), F.lit("bundled_contact"))
            .when((F.instr(value, "\n") > 0) | (F.instr(value, "**") > 0), F.lit("residual_markup")))


def canonical_type(raw_type: Column) -> Column:
    """Alias -> canonical entity_type; missing type -> ``unknown``."""
    t = F.coalesce(raw_type, F.lit("unknown"))
    return F.coalesce(dims.type_aliases()[t], t)


def parse_model_entities(model_outputs: DataFrame, categories=None) -> DataFrame:
    """entities(doc_id, seq, value, category, entity_type, confidence,
    source='llm'); ``seq`` keeps the model's list order."""
    allowed = list(categories) if categories else list(vocab.CATEGORIES)
    items = model_items(model_outputs)
    cleaned = items.withColumn("value", clean_model_value(F.col("raw_value")))
    kept = cleaned.where(F.col("category").isin(allowed) & F.col("raw_value").isNotNull()
                         & reject_reason(F.col("value")).isNull())
    return kept.select("doc_id", (F.col("pos") + 1).alias("seq"), "value", "category",
                       canonical_type(F.col("raw_type")).alias("entity_type"),
                       F.lit(None).cast("double").alias("confidence"), F.lit("llm").alias("source"))


def role_normal_form(c: Column) -> Column:
    """T5: strip, lower, spaces to ``_``."""
    return F.replace(F.lower(ustrip(c)), F.lit(" "), F.lit("_"))


def _value_map(model_outputs: DataFrame, stage: str, schema, field: str, role_field: str) -> DataFrame:
    items = _parse(model_outputs, stage, schema, field)
    rows = items.select("doc_id", "pos",
                        ustrip(F.coalesce(F.col("it.value"), F.lit(""))).alias("value"),
                        role_normal_form(F.coalesce(F.col(f"it.{role_field}"), F.lit(""))).alias("role"))
    rows = rows.where((F.length("value") > 0) & (F.length("role") > 0))
    # last assignment of a value wins
    return rows.groupBy("doc_id", "value").agg(F.max_by("role", "pos").alias("role"))


def parse_assignments(model_outputs: DataFrame) -> DataFrame:
    """(doc_id, value, role) from the role stage."""
    return _value_map(model_outputs, "roles", ASSIGNMENTS_SCHEMA, "assignments", "role")


def parse_ownership(model_outputs: DataFrame) -> DataFrame:
    """(doc_id, value, owner_role) from the ownership stage."""
    return _value_map(model_outputs, "ownership", OWNERSHIP_SCHEMA, "ownership", "owner_role") \
        .withColumnRenamed("role", "owner_role")
