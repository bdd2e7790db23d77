"""One row a document from the detectors to the final roles (D-2 ... D-18, R8, R9).

The text, the detected entities and the model's outputs of a document meet in
one row, in one shuffle on ``doc_id``.  From there every pass is a step over the
row's arrays: what a pass needs to know about the text comes from two Arrow
scans (``functions.value_scan``), the rules are array functions.  Nothing is
exploded, joined or grouped again until a query asks for entity rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims, vocab
from ..functions.binding import built_once, let
from ..functions.text import clean_model_value, rstrip_chars, ustrip
from ..functions.value_scan import related, value_facts
from . import classify as C
from . import detect as D
from . import merge as M
from . import parse as P
from . import roles as RO

_ENTITY = "struct<seq: int, value: string, category: string, entity_type: string, confidence: double, source: string>"
_PAIR = "struct<value: string, role: string>"


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


# ------------------------------------------------------------------ one shuffle

def _payload(stage: str, schema: T.StructType, field: str, role: str) -> Column:
    """The stage's list as (value, category, entity_type, role, given), values and roles in
    their normal form; null where it doesn't parse.  The list is cleaned in place: as columns
    of exploded items the same steps make one method that the JVM doesn't compile."""
    items = F.from_json(P.json_payload(F.col("raw")), schema, P._JSON_OPTS)[field]
    fields = {f.name for f in schema[field].dataType.elementType}

    def cleaned(it):
        of = lambda name: it[name] if name in fields else none("string")
        value = clean_model_value(it["value"]) if stage == "entities" else ustrip(F.coalesce(it["value"], F.lit("")))
        return F.struct(value.alias("value"), of("category").alias("category"), P.canonical_type(of("entity_type")).alias("entity_type"),
                        P.role_normal_form(F.coalesce(of(role), F.lit(""))).alias("role"), it["value"].isNotNull().alias("given"))

    return F.when(F.col("stage") == stage, F.transform(items, cleaned))


def model_lists(model_outputs: DataFrame, categories=None) -> DataFrame:
    """J1 to J3 per document, in one shuffle: ``llm`` (entities in the model's
    order), ``assigned`` and ``owned`` (value, role; the last of a value holds),
    ``model_ok`` (whether the output of the entity stage parses; null without one)
    and ``model_error``, the error of a call of that stage that gave no output."""
    allowed = list(categories) if categories else list(vocab.CATEGORIES)
    items = F.coalesce(_payload("entities", P.ENTITIES_SCHEMA, "entities", "role"),
                       _payload("roles", P.ASSIGNMENTS_SCHEMA, "assignments", "role"),
                       _payload("ownership", P.OWNERSHIP_SCHEMA, "ownership", "owner_role"))
    entity = F.col("stage") == "entities"
    given_error = F.col("error") if "error" in model_outputs.columns else none("string")
    error = F.when(entity & F.col("raw").isNull(), F.coalesce(given_error, F.lit("no output")))
    parsed = model_outputs.where(F.col("stage").isin("entities", "roles", "ownership")).select("doc_id", "stage", items.alias("items"), error.alias("error"))
    rows = parsed.select("doc_id", "stage", "error", F.col("items").isNotNull().alias("ok"), F.posexplode_outer("items").alias("pos", "it"))
    rows = rows.select("doc_id", "stage", "ok", "error", "pos", "it.*")
    listed = entity & F.col("category").isin(allowed) & F.col("given") & P.reject_reason(F.col("value")).isNull()
    named = (F.length("value") > 0) & (F.length("role") > 0)
    found = F.struct((F.col("pos") + 1).cast("int").alias("seq"), "value", "category", "entity_type", none("double").alias("confidence"), F.lit("llm").alias("source"))
    pair = F.struct("pos", "value", "role")
    return rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(listed, found))).alias("llm"),
        F.array_sort(F.collect_list(F.when((F.col("stage") == "roles") & named, pair))).alias("assigned"),
        F.array_sort(F.collect_list(F.when((F.col("stage") == "ownership") & named, pair))).alias("owned"),
        F.bool_or(F.when(entity, F.col("ok"))).alias("model_ok"), F.max("error").alias("model_error"))


def assemble(docs: DataFrame, model_outputs: DataFrame, categories=None, text_col: str = "content", lang_col: str | None = "language",
             recognizers=None, partitions: int | None = None) -> DataFrame:
    """``docs`` with ``detected``, ``g1``
    (without repeats), ``llm``, ``assigned``, ``owned``, ``model_ok``,
    ``model_error`` and ``doc_language``.

    ``lang_col`` None detects the language (C19); either way the rules take the
    effective one (B16).  A null text has no entities.  ``partitions``: how many to
    deal the documents over, the session's shuffle partitions by default; tasks
    take as long as their documents, so large inputs need more of them."""
    language = F.col(lang_col) if lang_col else C.detect_language(F.col(text_col))
    # Both sides are dealt by document before their texts are worked on, so the work is
    # spread however few rows the inputs have, and the join finds them in place.
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs, model_outputs = docs.repartition(partitions, "doc_id"), model_outputs.repartition(partitions, "doc_id")
    docs = docs.withColumn("doc_language", language).withColumn("_rules", D.effective_language(F.col("doc_language")))
    docs = D.detect_packed(docs, text_col, "_rules", categories, recognizers).drop("_rules")
    joined = docs.join(model_lists(model_outputs, categories), "doc_id", "left")
    empty = F.array().cast(f"array<{_ENTITY}>")
    joined = joined.withColumn("g1", let(F.coalesce("detected", empty), D.dedup_detected_array))
    return joined.withColumn("llm", F.coalesce("llm", empty))


# ------------------------------------------------------------------ merge (D-1 ... D-10)

def _holds(hay: Column, needle: Column) -> Column:
    return F.instr(hay, needle) > 0


def _judged(n: Column, hits: Column) -> Column:
    """D-2 to D-8: a pattern entity with the facts its related model entities give."""
    any_ = lambda test: F.exists(hits, test)
    inside = lambda x: _holds(x["low"], n["trim"]) & (n["trim"] != x["low"])
    facts = {
        "overlaps": F.size(hits) > 0,
        "inside_place": any_(lambda x: x["entity_type"].isin("indirizzo", "luogo_nascita", "cap_citta") & inside(x)),
        "fragment": any_(lambda x: (x["category"] != n["category"]) & inside(x)),
        "part_of_same": any_(lambda x: (x["entity_type"] == n["entity_type"]) & (n["trim"] != x["trim"]) & _holds(x["trim"], n["trim"])),
        "exact": any_(lambda x: x["trim"] == n["trim"]),
        "exact_same": any_(lambda x: (x["trim"] == n["trim"]) & (x["category"] == n["category"])),
        "covered": any_(lambda x: x["entity_type"] == n["entity_type"]),
        "in_email": any_(lambda x: (x["entity_type"] == "email") & _holds(x["low"], n["low"])),
    }
    return F.struct(n["e"].alias("e"), n["trim"].alias("trim"), hits.alias("hits"), *[v.alias(k) for k, v in facts.items()])


def _kept(x: Column) -> Column:
    e = x["e"]
    place = (e["entity_type"] == "indirizzo") & ~x["trim"].rlike(r"[,0-9]") & x["inside_place"]
    semantic = x["overlaps"] & ~place & ~x["fragment"] & ~x["part_of_same"] & ~(x["exact"] & ~x["exact_same"])
    structural = ~x["covered"] & ~((e["entity_type"] == "url") & x["in_email"])
    return F.when(e["entity_type"].isin(vocab.SEMANTIC_MERGE_TYPES), semantic).otherwise(structural)


def _named(arr: Column) -> Column:
    return F.transform(arr, lambda e: F.struct(e.alias("e"), F.lower(e["value"]).alias("low"), F.lower(ustrip(e["value"])).alias("trim"),
                                               e["category"].alias("category"), e["entity_type"].alias("entity_type"), e["seq"].alias("seq")))


def judge(rows: DataFrame) -> DataFrame:
    """D-1 to D-8: ``judged``, an array of the pattern entities with their facts and ``keep``."""
    low = lambda c: F.transform(c, lambda e: F.lower(e["value"]))
    rows = rows.withColumn("_related", related(low(F.col("g1")), low(F.col("llm"))))
    return rows.withColumn("judged", _judged_column()).drop("_related")


@built_once
def _judged_column() -> Column:
    return let(F.struct(_named(F.col("g1")).alias("g1"), _named(F.col("llm")).alias("llm"), F.col("_related").alias("related")), lambda r: F.transform(
        r["g1"], lambda n, i: let(F.transform(F.get(r["related"], i), lambda j: F.get(r["llm"], j)), lambda hits: let(
            _judged(n, hits), lambda x: x.withField("keep", _kept(x))))))


def merged(judged: Column, llm: Column) -> Column:
    """D-9, D-10: model entities, then the kept pattern entities, numbered; dates that are a birth date go."""
    added = F.transform(F.filter(judged, lambda x: x["keep"]), lambda x: x["e"].withField("source", F.lit("merged")))
    both = F.transform(F.concat(llm, added), lambda e, i: e.withField("seq", (i + 1).cast("int")))
    trim = lambda e: F.lower(ustrip(e["value"]))
    births = lambda b: F.transform(F.filter(b, lambda e: (e["category"] == "persone_fisiche") & (e["entity_type"] == "data_nascita")), trim)
    return let(both, lambda b: let(births(b), lambda born: F.filter(
        b, lambda e: ~((e["category"] == "dati_temporali") & F.array_contains(born, trim(e))))))


# ------------------------------------------------------------------ identification (D-11, D-12, B8, C18)

def _candidates(merged: Column, found: Column) -> Column:
    """The merged entities, then the institutions found in the text, with what the scan of the text needs."""
    old = F.transform(merged, lambda e: F.struct(e.alias("e"), F.lit(False).alias("found")))
    new = F.transform(found, lambda v: F.struct(F.struct(
        F.lit(0).alias("seq"), v.alias("value"), F.lit("persone_giuridiche").alias("category"), F.lit("nome_organizzazione").alias("entity_type"),
        F.lit(vocab.INSTITUTION_CONFIDENCE).alias("confidence"), F.lit("ner").alias("source")).alias("e"), F.lit(True).alias("found")))
    person = lambda x: (x["e"]["category"] == "persone_fisiche") & ~x["found"]
    return F.transform(F.concat(old, new), lambda x: F.struct(
        x["e"].alias("e"), x["found"].alias("found"), (person(x) & x["e"]["value"].rlike(M.CORPORATE_SUFFIX_RE)).alias("by_suffix"),
        F.when(person(x) & ~x["e"]["value"].rlike(M.CORPORATE_SUFFIX_RE), F.lower(x["e"]["value"])).alias("candidate"),
        rstrip_chars(F.lower(ustrip(x["e"]["value"])), ".").alias("norm")))


def _retyped(cands: Column, facts: Column) -> Column:
    """D-11, D-12, B8: persons that are companies; ``keep`` false for a malformed fiscal code."""
    def one(x, i):
        context = F.coalesce(F.get(facts["legal"], i), F.lit(False))
        flip = x["by_suffix"] | context
        e = x["e"].withField("category", F.when(flip, F.lit("persone_giuridiche")).otherwise(x["e"]["category"])) \
                  .withField("entity_type", F.when(flip, F.lit("nome_azienda")).otherwise(x["e"]["entity_type"]))
        bad = (e["entity_type"] == "codice_fiscale") & ~ustrip(e["value"]).rlike(vocab.FISCAL_CODE_PATTERN)
        return F.struct(e.alias("e"), x["found"].alias("found"), x["by_suffix"].alias("by_suffix"), context.alias("by_context"), (~bad).alias("keep"))
    return F.transform(cands, one)


def _with_institutions(retyped: Column) -> Column:
    """An institution is kept unless it lies in a known value or an earlier find; numbered after the others."""
    valid = lambda r: F.filter(r, lambda x: ~x["found"] & x["keep"])
    start = lambda r: F.struct(
        F.transform(valid(r), lambda x: F.lower(x["e"]["value"])).alias("seen"),
        F.coalesce(F.array_max(F.transform(valid(r), lambda x: x["e"]["seq"])), F.lit(0)).alias("n"), F.filter(r, lambda x: ~x["found"]).alias("out"))

    def step(acc, x):
        low = F.lower(x["e"]["value"])
        known = F.exists(acc["seen"], lambda s: _holds(s, low))
        n = F.when(known, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(known, acc["seen"]).otherwise(F.array_append(acc["seen"], low)).alias("seen"), n.alias("n"),
                        F.array_append(acc["out"], x.withField("e", x["e"].withField("seq", n)).withField("keep", ~known)).alias("out"))

    return let(retyped, lambda r: F.aggregate(F.filter(r, lambda x: x["found"]), start(r), step)["out"])


def identified(rows: DataFrame, text_col: str = "content") -> DataFrame:
    """``merged`` (D-9, D-10), ``facts`` (the scan) and ``entities``: every merged
    entity and find, in order, with ``keep`` and why it was re-typed."""
    rows = rows.withColumn("_cands", _candidates_column(text_col))
    of = lambda name: F.transform("_cands", lambda x: x[name])
    rows = rows.withColumn("facts", value_facts(F.col(text_col), F.transform("_cands", lambda x: x["e"]["value"]), of("candidate"), of("norm")))
    return rows.withColumn("entities", _entities_column()).drop("_cands")


@built_once
def _candidates_column(text_col: str) -> Column:
    named = reduce(or_, [F.instr(F.col(text_col), word) > 0 for word in vocab.INSTITUTION_WORDS])
    found = F.when(named, F.transform(F.regexp_extract_all(F.col(text_col), F.lit(M.INSTITUTION_RE), 0), ustrip)).otherwise(F.array().cast("array<string>"))
    return let(F.struct(F.col("judged"), F.col("llm"), found.alias("found")), lambda r: let(
        merged(r["judged"], r["llm"]), lambda m: _candidates(m, r["found"])))


@built_once
def _entities_column() -> Column:
    return let(F.struct(F.col("_cands").alias("cands"), F.col("facts")), lambda r: _with_institutions(_retyped(r["cands"], r["facts"])))


# ------------------------------------------------------------------ roles (D-13 ... D-18)

def _remapped(x: Column, role: Column, doc_type: Column) -> Column:
    to = dims.role_constraints()[dims.role_constraint_key(doc_type, role)]
    return F.when(x["e"]["category"].isin(vocab.ROLE_CATEGORIES) & role.isNotNull(), F.coalesce(to, role)).otherwise(role)


def _last_of(pairs: Column, value: Column) -> Column:
    hits = F.filter(pairs, lambda p: p["value"] == value)
    return F.get(hits, F.size(hits) - 1)["role"]


def _roles(r: Column) -> Column:
    """Passes 1 to 3.5 over ``r`` (entities, facts, assigned, owned, doc_type); each pass adds its own field."""
    doc_type, facts = r["doc_type"], r["facts"]

    def looked_up(x, i):
        actor = x["keep"] & RO.is_actor(x["e"]["category"], x["e"]["entity_type"])
        return let(actor, lambda a: let(F.when(a, _last_of(r["assigned"], x["e"]["value"])), lambda role: x.withField("i", i).withField("actor", a)
                                        .withField("looked_up", role).withField("remapped", _remapped(x, role, doc_type))))

    def owned(all_):
        given = lambda test: F.array_distinct(F.transform(F.filter(all_, lambda x: x["actor"] & x["remapped"].isNotNull() & test(x)), lambda x: x["remapped"]))
        return let(F.struct(given(lambda x: F.lit(True)).alias("valid"), given(lambda x: x["e"]["category"] == "persone_fisiche").alias("persons")), lambda g: F.transform(
            all_, lambda x: let(F.when(~x["actor"] & x["keep"] & x["remapped"].isNull() & (F.size(g["valid"]) > 0), _last_of(r["owned"], x["e"]["value"])), lambda own: x.withField(
                "owned", F.when(own.isNull(), x["remapped"]).when(
                    ~F.array_contains(F.array_append(g["valid"], F.lit(vocab.OWNER_CATCH_ALL)), own) & (F.size(g["persons"]) == 1), F.get(g["persons"], F.lit(0))).otherwise(own)))))

    def same_type(all_):
        donor = lambda x: lambda j: let(F.get(all_, j), lambda d: d["keep"] & d["owned"].isNotNull() & (d["e"]["entity_type"] == x["e"]["entity_type"]))
        return F.transform(all_, lambda x: x.withField("alike", F.when(x["owned"].isNotNull() | ~x["keep"], x["owned"]).otherwise(
            F.get(all_, F.get(F.filter(F.get(facts["related"], x["i"]), donor(x)), F.lit(0)))["owned"])))

    def nearest(all_):
        donor = lambda j: let(F.get(all_, j), lambda d: d["keep"] & d["alike"].isNotNull() & d["e"]["entity_type"].isin(vocab.PROXIMITY_DONOR_TYPES))
        found = lambda x: F.when(x["alike"].isNotNull() | ~x["keep"], x["alike"]).otherwise(
            F.get(all_, F.get(F.filter(F.get(facts["near"], x["i"]), donor), F.lit(0)))["alike"])
        return let(F.exists(all_, lambda x: x["actor"]), lambda some: F.transform(all_, lambda x: let(found(x), lambda near: x.withField(
            "near", near).withField("role", F.when(some, _remapped(x, near, doc_type))))))

    out = F.transform(r["entities"], looked_up)
    for step in (owned, same_type, nearest):
        out = let(out, step)
    return out


def with_roles(rows: DataFrame, text_col: str = "content", override_col: str | None = None) -> DataFrame:
    """B14, C20, D-13 to D-18: ``doc_type`` and, in ``entities``, the role after each pass."""
    override = F.col(override_col) if override_col else none("string")
    rows = rows.withColumn("doc_type", C.effective_doc_type(override, C.detect_doc_type(F.col(text_col))))
    return rows.withColumn("entities", _roles_column())


@built_once
def _roles_column() -> Column:
    pairs = lambda c: F.coalesce(F.transform(c, lambda p: F.struct(p["value"].alias("value"), p["role"].alias("role"))), F.array().cast(f"array<{_PAIR}>"))
    return let(F.struct(F.col("entities"), F.col("facts"), pairs("assigned").alias("assigned"), pairs("owned").alias("owned"), F.col("doc_type")), _roles)


# ------------------------------------------------------------------ entity rows

def entity_rows(rows: DataFrame, *keep: str, **fields: str) -> DataFrame:
    """A row an entity that is kept: doc_id, the columns ``keep``, the entity's own and named ``fields`` of its element."""
    out = D.explode_outer_nonnull(rows, "entities", ("doc_id", *keep), alias="x").where("x.keep")
    own = ["seq", "value", "category", "entity_type", "confidence", "source"]
    return out.select("doc_id", *keep, *[F.col(f"x.e.{c}").alias(c) for c in own], *[F.col(f"x.{v}").alias(k) for k, v in fields.items()])


def packed_entities(entities: Column) -> Column:
    """The kept entities as labels and substitution take them, with their roles."""
    return F.transform(F.filter(entities, lambda x: x["keep"]), lambda x: F.struct(
        x["e"]["seq"].alias("seq"), x["e"]["value"].alias("value"), x["e"]["category"].alias("category"),
        x["e"]["entity_type"].alias("entity_type"), x["role"].alias("semantic_role")))
