"""Contextual roles and ownership (B11, D-13 ... D-18, R9).

Inputs: identified entities ``(doc_id, seq, value, category, entity_type,
...)``, the documents (text + optional type override) and the parsed model
maps ``assignments(doc_id, value, role)`` and ``ownership(doc_id, value,
owner_role)``.  Output: the entities with ``semantic_role`` and the
document's ``doc_type``.

Passes (in order): 1 role lookup for actors -> 1.5 remap by document type ->
2 ownership for data entities -> 3A same-type propagation -> 3B proximity
propagation -> 3.5 remap again.  A document without actors keeps all roles
empty.  Every step is a join keyed on ``doc_id``; proximity (3B) is a range
join done as an equi-join on (doc_id, 201-character bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims, vocab
from ..functions.text import rstrip_chars, ustrip
from .classify import detect_doc_type, effective_doc_type
from .containment import contains_pairs

BIN = vocab.PROXIMITY_THRESHOLD + 1


def is_actor(category: Column, entity_type: Column) -> Column:
    """Persons named as persons, organisations named as organisations."""
    return (((category == "persone_fisiche") & entity_type.isin(vocab.PERSON_ROLE_TYPES))
            | ((category == "persone_giuridiche") & entity_type.isin(vocab.ORG_ROLE_TYPES)))


def remap_roles(df: DataFrame) -> DataFrame:
    """D-18: role -> replacement for (doc_type, role), role categories only."""
    m = dims.role_constraints()[dims.role_constraint_key(F.col("doc_type"), F.col("semantic_role"))]
    applies = F.col("category").isin(vocab.ROLE_CATEGORIES) & F.col("semantic_role").isNotNull() & m.isNotNull()
    return df.withColumn("semantic_role", F.when(applies, m).otherwise(F.col("semantic_role")))


def doc_types(docs: DataFrame, text_col: str = "content", override_col: str | None = None) -> DataFrame:
    """B14 + C20 per document: (doc_id, doc_type)."""
    override = F.col(override_col) if override_col else F.lit(None).cast("string")
    return docs.select("doc_id", effective_doc_type(override, detect_doc_type(F.col(text_col))).alias("doc_type"))


def assign_roles(entities: DataFrame, doc_type: DataFrame, assignments: DataFrame) -> DataFrame:
    """Pass 1 + 1.5 (D-13, D-18)."""
    e = entities.join(doc_type, "doc_id", "left").withColumn("actor", is_actor(F.col("category"), F.col("entity_type")))
    a = assignments.select(F.col("doc_id").alias("adoc"), F.col("value").alias("aval"), F.col("role").alias("arole"))
    j = e.join(a, (e["doc_id"] == a["adoc"]) & (e["value"] == a["aval"]) & e["actor"], "left")
    j = j.withColumn("semantic_role", F.when(F.col("actor"), F.col("arole")).otherwise(F.lit(None).cast("string")))
    return remap_roles(j.drop("adoc", "aval", "arole"))


def assign_ownership(e: DataFrame, ownership: DataFrame) -> DataFrame:
    """Pass 2 (D-14, D-15): data entities take their owner's role; an owner
    role outside the actor roles (plus ``documento``) falls back to the sole
    person role when exactly one exists."""
    actor_roles = (e.where(F.col("actor") & F.col("semantic_role").isNotNull())
                    .groupBy("doc_id")
                    .agg(F.collect_set("semantic_role").alias("valid"),
                         F.collect_set(F.when(F.col("category") == "persone_fisiche", F.col("semantic_role")))
                          .alias("person_roles")))
    o = ownership.select(F.col("doc_id").alias("odoc"), F.col("value").alias("oval"), "owner_role")
    j = (e.join(actor_roles, "doc_id", "left")
          .join(o, (F.col("doc_id") == F.col("odoc")) & (F.col("value") == F.col("oval"))
                & ~F.col("actor") & F.col("semantic_role").isNull(), "left"))
    valid = F.array_union(F.coalesce("valid", F.array().cast("array<string>")), F.array(F.lit(vocab.OWNER_CATCH_ALL)))
    default = F.when(F.size("person_roles") == 1, F.get(F.col("person_roles"), F.lit(0)))
    owner = F.when(~F.array_contains(valid, F.col("owner_role")) & default.isNotNull(), default) \
             .otherwise(F.col("owner_role"))
    has_summary = F.size(F.coalesce("valid", F.array().cast("array<string>"))) > 0
    role = F.when(F.col("owner_role").isNotNull() & has_summary, owner).otherwise(F.col("semantic_role"))
    return j.withColumn("semantic_role", role).drop("odoc", "oval", "owner_role", "valid", "person_roles")


def propagate_same_type(e: DataFrame) -> DataFrame:
    """Pass 3A (D-16): an entity without role takes the role of the first
    donor (by seq) of the same type whose normalised value contains it or
    is contained in it; donors are the entities resolved before the pass."""
    norm = rstrip_chars(F.lower(ustrip(F.col("value"))), ".")
    base = e.withColumn("nv", norm)
    donors = base.where(F.col("semantic_role").isNotNull()).select(
        F.col("doc_id").alias("ddoc"), F.col("seq").alias("dseq"), F.col("entity_type").alias("dtype"),
        F.col("nv").alias("dnv"), F.col("semantic_role").alias("drole"))
    need = base.where(F.col("semantic_role").isNull()).select("doc_id", "seq", "entity_type", "nv")
    d = donors.withColumnRenamed("ddoc", "doc_id").withColumnRenamed("dtype", "entity_type")
    keys = ["doc_id", "entity_type"]
    # containment either way via anchored joins; an empty normalised value is
    # contained in everything (Python ``"" in s``), so it pairs with every
    # same-type entity of its document
    pairs = (contains_pairs(d, need.where(F.length("nv") > 0), keys, "dnv", "nv")
             .unionByName(contains_pairs(need, d.where(F.length("dnv") > 0), keys, "nv", "dnv"))
             .unionByName(need.where(F.length("nv") == 0).join(d, keys))
             .unionByName(need.join(d.where(F.length("dnv") == 0), keys)))
    got = pairs.groupBy("doc_id", "seq").agg(F.min_by("drole", "dseq").alias("prop_role"))
    out = base.join(got, ["doc_id", "seq"], "left")
    return out.withColumn("semantic_role", F.coalesce("semantic_role", "prop_role")).drop("prop_role", "nv")


def propagate_proximity(e: DataFrame, docs: DataFrame, text_col: str = "content") -> DataFrame:
    """Pass 3B (D-17): an entity without role, found in the text, takes the
    role of the nearest resolved person/organisation (first occurrences,
    distance <= 200 characters; ties -> first donor by seq)."""
    pos = (e.select("doc_id", "seq", "value")
            .join(docs.select("doc_id", F.col(text_col).alias("text")), "doc_id")
            .select("doc_id", "seq", (F.instr("text", F.col("value")) - 1).alias("pos")))
    p = e.join(pos, ["doc_id", "seq"], "left")
    donors = (p.where(F.col("semantic_role").isNotNull() & F.col("entity_type").isin(vocab.PROXIMITY_DONOR_TYPES)
                      & (F.col("pos") >= 0))
               .select(F.col("doc_id").alias("ddoc"), F.col("seq").alias("dseq"), F.col("pos").alias("dpos"),
                       F.col("semantic_role").alias("drole"),
                       F.explode(F.array(*[F.floor(F.col("pos") / BIN) + k for k in (-1, 0, 1)])).alias("dbin")))
    need = (p.where(F.col("semantic_role").isNull() & (F.col("pos") >= 0))
             .select("doc_id", "seq", "pos", F.floor(F.col("pos") / BIN).alias("bin")))
    cond = ((need["doc_id"] == donors["ddoc"]) & (need["bin"] == donors["dbin"])
            & (F.abs(donors["dpos"] - need["pos"]) <= vocab.PROXIMITY_THRESHOLD))
    got = (need.join(donors, cond, "inner").groupBy("doc_id", "seq")
               .agg(F.min_by("drole", F.struct(F.abs(F.col("dpos") - F.col("pos")), F.col("dseq"))).alias("prox_role")))
    out = p.join(got, ["doc_id", "seq"], "left")
    return out.withColumn("semantic_role", F.coalesce("semantic_role", "prox_role")).drop("prox_role", "pos")


def assign_all_roles(entities: DataFrame, docs: DataFrame, assignments: DataFrame, ownership: DataFrame,
                     text_col: str = "content", override_col: str | None = None) -> DataFrame:
    """The whole role stage.  Documents without any actor keep every
    role empty (no ownership, no propagation)."""
    dt = doc_types(docs, text_col, override_col)
    e = assign_roles(entities, dt, assignments)
    e = assign_ownership(e, ownership)
    e = propagate_same_type(e)
    e = propagate_proximity(e, docs, text_col)
    e = remap_roles(e)
    has_actor = F.max(F.col("actor").cast("int")).over(Window.partitionBy("doc_id")) == 1
    e = e.withColumn("semantic_role", F.when(has_actor, F.col("semantic_role")))
    return e.drop("actor")
