"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the given tables (or data Spark derives from them) in
full; there are no row caps or id filters.  The SQL twins used by the
correctness gate live in ``plans/oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recognizers as R
from ..operators import detect as D
from ..operators import parse as P
from ..operators import redact as X
from ..sources import derived as DV
from ..sources import tables as T
from ..session import apply_runtime_conf, ensure_checkpoint_dir
from .. import vocab
from ..functions.text import clean_model_value
from ..functions.text import clean_span as X_clean
from ..operators import classify as C
from ..operators import record as RC
from ..operators import review as RV
from ..operators import roles as RO
from ..operators import evaluate as EV
from ..operators import extract as EX
from ..operators import governance as G
from ..operators import lookup as LK
from ..operators import model as MD
from ..sources import io as IO
from ..functions import labels as LB
from pyspark.sql import Window


def _recs(*types):
    return [r for r in R.DEFAULT_RECOGNIZERS if r.detector_type in types]


def _docs(spark, sf_dir):
    return T.ensure_parallelism(T.documents(spark, sf_dir))


def _detect_only(types):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return (D.detect(_docs(spark, sf_dir), recognizers=_recs(*types))
                .select("doc_id", "seq", "value", "category", "entity_type", "confidence"))
    return q


def detector_only_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: language first (C19, B16), then every recogniser over every document."""
    language = D.effective_language(C.detect_language(F.col("content")))
    return D.detect(_docs(spark, sf_dir).withColumn("language", language)).select(
        "doc_id", "seq", "value", "category", "entity_type", "confidence", "source")


def count_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected entities per category, zero-filled over all six."""
    from ..dims import categories_df
    ents = D.detect(_docs(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))
    return (F.broadcast(categories_df(spark)).join(ents, "category", "left")
            .select("category", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_entities")))


def dedup_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 on the packed per-document array (no shuffle)."""
    packed = D.detect_packed(_docs(spark, sf_dir).select("doc_id", "content", "language"))
    packed = packed.withColumn("dedup", D.dedup_detected_array(F.col("detected")))
    return D.explode_entities(packed, "dedup").select(
        "doc_id", "seq", "value", "entity_type", "confidence")


def _redact(types=None):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        recs = _recs(*types) if types else R.unconfirmed_safe()
        docs = _docs(spark, sf_dir).select("doc_id", "content", "language")
        packed = D.detect_packed(docs, recognizers=recs)
        packed = packed.withColumn("ents", F.transform("detected", lambda e: F.struct(
            e["seq"].alias("seq"), e["value"].alias("value"), e["category"].alias("category"),
            e["entity_type"].alias("entity_type"), F.lit(None).cast("string").alias("semantic_role"))))
        out = X.anonymize_packed(packed, "ents")
        return out.select("doc_id", F.size("mappings").cast("bigint").alias("n_mappings"),
                          F.col("anonymized"))
    return q


# ------------------------------------------------------------ model outputs

def parse_model_entities(spark, sf_dir):
    """J1 over the model outputs of every derived document."""
    return P.parse_model_entities(_model(spark, sf_dir)).select(
        "doc_id", "seq", "value", "category", "entity_type")


def clean_values(spark, sf_dir):
    """Raw model value -> cleaned value, every item."""
    items = P.model_items(_model(spark, sf_dir)).where(F.col("raw_value").isNotNull())
    return items.select("doc_id", "pos", "raw_value", clean_model_value(F.col("raw_value")).alias("value"))


def reject_bundled(spark, sf_dir):
    """Cleaned values rejected, with the reason."""
    items = P.model_items(_model(spark, sf_dir)).where(F.col("raw_value").isNotNull())
    v = clean_model_value(F.col("raw_value"))
    return (items.select("doc_id", "pos", v.alias("value"))
            .withColumn("reason", P.reject_reason(F.col("value")))
            .where(F.col("reason").isNotNull()))


def type_alias(spark, sf_dir):
    """Raw entity_type -> canonical entity_type, every item."""
    items = P.model_items(_model(spark, sf_dir))
    return items.select("doc_id", "pos", "raw_type", P.canonical_type(F.col("raw_type")).alias("entity_type"))


def parse_assignments(spark, sf_dir):
    return P.parse_assignments(_model(spark, sf_dir))


def parse_ownership(spark, sf_dir):
    return P.parse_ownership(_model(spark, sf_dir))


# ------------------------------------------------------------ merge stage

def _spread(df: DataFrame, partitions: int) -> DataFrame:
    """The derived inputs are laid out by joins of small rows; their texts are
    the work, so they are dealt over partitions of a bounded number of documents."""
    return df.repartition(partitions, "doc_id")


def _ddocs(spark, sf_dir):
    return _spread(DV.documents(spark, sf_dir), DV.partitions(spark, sf_dir))


def _model(spark, sf_dir):
    return _spread(DV.model_outputs(spark, sf_dir), DV.partitions(spark, sf_dir))


def _assembled(spark, sf_dir):
    """The derived documents with both detectors' entities (``operators.record``)."""
    return RC.assemble(DV.documents(spark, sf_dir), DV.model_outputs(spark, sf_dir), partitions=DV.partitions(spark, sf_dir))


def _identified(spark, sf_dir):
    return RC.identified(RC.judge(_assembled(spark, sf_dir)))


def _ident(spark, sf_dir):
    return RC.entity_rows(_identified(spark, sf_dir))


def false_positive_filter(spark, sf_dir):
    """Every rule-recogniser hit with its deny-list / IBAN-fragment verdict."""
    docs = _ddocs(spark, sf_dir).select("doc_id", "content", "language")
    hits = D.explode_outer_nonnull(
        docs.select("doc_id", "language", R.match_array(F.col("content"), R.SEMANTIC).alias("m")),
        "m", ("doc_id", "language"), alias="h")
    hits = hits.withColumn("value", X_clean(F.col("h.value")))
    return hits.select("doc_id", F.col("h.rank").alias("rank"), F.col("h.occ").alias("occ"),
                       "value", F.col("h.detector_type").alias("detector_type"),
                       D.is_semantic_false_positive(F.col("value"), F.col("h.detector_type"), F.col("language"))
                       .alias("is_false_positive"))


def _judged(spark, sf_dir, *keep):
    rows = RC.judge(_assembled(spark, sf_dir))
    return D.explode_outer_nonnull(rows, "judged", ("doc_id", *keep), alias="x")


def overlap_join(spark, sf_dir):
    """D-1 over the de-duplicated pattern entities and the model entities."""
    pairs = _judged(spark, sf_dir).select("doc_id", F.col("x.e.seq").alias("nseq"), F.explode_outer("x.hits.seq").alias("lseq"))
    return pairs.where(F.col("lseq").isNotNull())


def _survivors(semantic: bool):
    def q(spark, sf_dir):
        cond = F.col("x.e.entity_type").isin(vocab.SEMANTIC_MERGE_TYPES)
        kept = _judged(spark, sf_dir).where(F.col("x.keep") & (cond if semantic else ~cond))
        return kept.select("doc_id", "x.e.seq", "x.e.value", "x.e.entity_type")
    return q


def url_in_email(spark, sf_dir):
    """D-8: URL fragments dropped because a model e-mail contains them."""
    hit = (F.col("x.e.entity_type") == "url") & F.col("x.in_email") & ~F.col("x.covered")
    return _judged(spark, sf_dir).where(hit).select("doc_id", "x.e.seq", "x.e.value")


def date_dedup(spark, sf_dir):
    """D-9 + D-10: the merged entity list."""
    rows = RC.judge(_assembled(spark, sf_dir)).withColumn("merged", RC.merged(F.col("judged"), F.col("llm")))
    return D.explode_outer_nonnull(rows, "merged", ("doc_id",)).select(
        "doc_id", *[f"e.{c}" for c in ("seq", "value", "category", "entity_type", "source")])


def _retyped(spark, sf_dir):
    return D.explode_outer_nonnull(_identified(spark, sf_dir), "entities", ("doc_id",), alias="x")


def legal_suffix(spark, sf_dir):
    """D-11: person entities re-typed because of a corporate suffix."""
    return _retyped(spark, sf_dir).where("x.by_suffix").select("doc_id", "x.e.seq", "x.e.value")


def legal_context(spark, sf_dir):
    """D-12: person entities re-typed because a legal phrase is near them."""
    return _retyped(spark, sf_dir).where("x.by_context").select("doc_id", "x.e.seq", "x.e.value")


def fiscal_code_validate(spark, sf_dir):
    """codice_fiscale entities removed by the final shape check."""
    return _retyped(spark, sf_dir).where("not x.keep and not x.found").select("doc_id", "x.e.seq", "x.e.value", "x.e.entity_type")


def institutions(spark, sf_dir):
    """Institution entities appended after the merge."""
    return _retyped(spark, sf_dir).where("x.keep and x.found").select("doc_id", "x.e.seq", "x.e.value")


def identify(spark, sf_dir):
    """Whole identification stage: merge, legal re-typing, fiscal check, institutions."""
    return _ident(spark, sf_dir).select("doc_id", "seq", "value", "category", "entity_type", "source")


def doc_type(spark, sf_dir):
    """C20 over the derived documents."""
    return _ddocs(spark, sf_dir).select("doc_id", C.detect_doc_type(F.col("content")).alias("doc_type"))


def language_detect(spark, sf_dir):
    """C19 over the real documents."""
    return _docs(spark, sf_dir).select("doc_id", "language",
                                       C.detect_language(F.col("content")).alias("detected_language"))


# ------------------------------------------------------------ roles

def _roles(spark, sf_dir):
    return RC.with_roles(_identified(spark, sf_dir))


def _role_rows(spark, sf_dir):
    """A row an entity, with the role after each pass."""
    return RC.entity_rows(_roles(spark, sf_dir), "doc_type", actor="actor", looked_up="looked_up", remapped="remapped", owned="owned",
                          alike="alike", near="near", semantic_role="role")


def assign_roles(spark, sf_dir):
    """D-13 + 1.5: actor roles from the role stage, remapped by document type."""
    return _role_rows(spark, sf_dir).where("actor").select("doc_id", "seq", "value", F.col("remapped").alias("role_lookup"))


def role_remap(spark, sf_dir):
    """D-18: actors whose looked-up role the document type remaps."""
    return _role_rows(spark, sf_dir).where("actor and looked_up <> remapped").select(
        "doc_id", "seq", "doc_type", F.col("looked_up").alias("before"), F.col("remapped").alias("after"))


def ownership(spark, sf_dir):
    """D-14/D-15: data entities that received an owner role."""
    return _role_rows(spark, sf_dir).where("not actor and owned is not null").select("doc_id", "seq", "value", F.col("owned").alias("owner"))


def propagate_same_type(spark, sf_dir):
    """D-16: entities resolved by same-type substring donors."""
    return _role_rows(spark, sf_dir).where("owned is null and alike is not null").select("doc_id", "seq", "value", F.col("alike").alias("role"))


def propagate_proximity(spark, sf_dir):
    """D-17: entities resolved by the nearest actor within 200 characters."""
    return _role_rows(spark, sf_dir).where("alike is null and near is not null").select("doc_id", "seq", "value", F.col("near").alias("role"))


def roles_final(spark, sf_dir):
    """Every identified entity with its final role and the document type."""
    return _role_rows(spark, sf_dir).select("doc_id", "seq", "value", "category", "entity_type", "semantic_role", "doc_type")


# ------------------------------------------------------------ labels and substitution

def _final(spark, sf_dir):
    """The derived documents, a row each, with ``ents``: entities with their roles."""
    return _roles(spark, sf_dir).withColumn("ents", RC.packed_entities(F.col("entities")))


def label_choice(spark, sf_dir):
    """R2: Italian placeholder label of every entity."""
    return _role_rows(spark, sf_dir).select("doc_id", "seq", LB.label_for(F.col("category"), F.col("entity_type"), F.col("semantic_role")).alias("label"))


def label_localise(spark, sf_dir):
    """The label rendered in the document language."""
    rows = _final(spark, sf_dir).withColumn("labelled", F.arrays_zip(F.col("ents.seq").alias("seq"), X.localised_labels(F.col("ents"), F.col("language")).alias("label")))
    return D.explode_outer_nonnull(rows, "labelled", ("doc_id",)).select("doc_id", "e.seq", "e.label")


def _packed(r: DataFrame) -> DataFrame:
    """Entities of each document as one seq-ordered array (one shuffle of
    entity rows on doc_id; the text is not part of it)."""
    return r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "seq", "value", "category", "entity_type", "semantic_role"))).alias("ents"))


def greedy_dedup(spark, sf_dir):
    """Values kept for substitution."""
    rows = _final(spark, sf_dir).withColumn("kept", X.greedy_dedup(F.col("ents")))
    return D.explode_outer_nonnull(rows, "kept", ("doc_id",)).select("doc_id", "e.seq", "e.value", "e.entity_type")


def _numbered(spark, sf_dir, ents, name):
    rows = _final(spark, sf_dir).withColumn("m", X.number_placeholders(ents, F.col("language")))
    return D.explode_outer_nonnull(rows, "m", ("doc_id",)).select("doc_id", "e.ord", "e.original", F.col("e.replacement").alias(name))


def number_placeholders(spark, sf_dir):
    """W1 (+R2, R3): the per-document mapping value -> [LABEL_n]."""
    return _numbered(spark, sf_dir, X.greedy_dedup(F.col("ents")), "replacement")


def preview_numbers(spark, sf_dir):
    """Preview placeholders over the entities before de-duplication."""
    return _numbered(spark, sf_dir, F.col("ents"), "proposed_replacement")


def _redact_final(isolate: bool):
    def q(spark, sf_dir):
        out = X.anonymize_packed(_final(spark, sf_dir), "ents", isolate=isolate)
        return out.select("doc_id", F.size("mappings").cast("bigint").alias("n_mappings"), "anonymized")
    return q


def redact_conversations(spark, sf_dir):
    """Consistent redaction across the turns of one conversation: detect per
    turn, build one mapping per conversation, apply it to every turn."""
    conv = T.ensure_parallelism(T.conversations(spark, sf_dir))
    turns = conv.select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("content"),
                        F.lit(None).cast("string").alias("language"))
    det = D.detect_packed(turns, lang_col="language", recognizers=R.unconfirmed_safe())
    ents = (D.explode_outer_nonnull(det, "detected", ("doc_id", "turn"))
            .select("doc_id", "turn", F.col("e.seq").alias("tseq"), F.col("e.value").alias("value"),
                    F.col("e.category").alias("category"), F.col("e.entity_type").alias("entity_type")))
    w = Window.partitionBy("doc_id").orderBy("turn", "tseq")
    ents = ents.withColumn("seq", F.row_number().over(w)).withColumn("semantic_role", F.lit(None).cast("string"))
    maps = _packed(ents).select("doc_id", X.number_placeholders(X.greedy_dedup(F.col("ents")), F.lit("it")).alias("mappings"))
    j = conv.join(maps, F.col("conv_id") == F.col("doc_id"), "left")
    red = X.substitute(F.col("text"), F.coalesce("mappings", F.array().cast(maps.schema["mappings"].dataType)))
    return j.select("conv_id", "turn", "role", red.alias("anonymized"))


# ------------------------------------------------------------ evaluation

def _eval_inputs(spark, sf_dir):
    docs = _ddocs(spark, sf_dir)
    truth = DV.ground_truth(spark, sf_dir).select("doc_id", "value", "category")
    pred = _ident(spark, sf_dir).select("doc_id", "value", "category")
    return (docs, *EV.evaluable(pred, truth))


def eval_strict(spark, sf_dir):
    docs, pred, truth = _eval_inputs(spark, sf_dir)
    return EV.strict_counts(pred, truth)


def eval_lenient(spark, sf_dir):
    docs, pred, truth = _eval_inputs(spark, sf_dir)
    return EV.lenient_counts(pred, truth)


def eval_grouping_sets(spark, sf_dir):
    """G6 + G7 + T4: the evaluation report."""
    docs, pred, truth = _eval_inputs(spark, sf_dir)
    lang = docs.select("doc_id", EV.language_from_name(F.col("filename")).alias("lang"))
    return EV.report(spark, EV.strict_counts(pred, truth), lang)


def eval_sorted_report(spark, sf_dir):
    """S3: the report in the order it is printed."""
    return EV.sorted_report(eval_grouping_sets(spark, sf_dir))


def eval_skipped(spark, sf_dir):
    """D-22: documents that can't be evaluated, by the runs of the extract: those
    without an annotation, and those whose model output didn't parse."""
    docs = DV.documents(spark, sf_dir).select("doc_id")
    truth = DV.ground_truth(spark, sf_dir).where("category = 'dati_temporali'").select("doc_id", "value", "category")
    lists = RC.model_lists(DV.model_outputs(spark, sf_dir))
    runs = lists.select("doc_id", F.when(F.col("model_ok"), F.lit("success")).otherwise(F.lit("error")).alias("status"))
    return EV.skipped(docs, truth, runs)


def entity_counts(spark, sf_dir):
    """Detected and annotated entities of each document."""
    found = _identified(spark, sf_dir).select("doc_id", F.size(F.filter("entities", lambda x: x["keep"])).cast("bigint").alias("n_pred"))
    truth = DV.ground_truth(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_gt"))
    return found.join(truth, "doc_id", "left").select("doc_id", "n_pred", F.coalesce("n_gt", F.lit(0)).alias("n_gt"))


def run_summary(spark, sf_dir):
    """Per category and source, entities found in the run,
    plus documents whose model output parsed (success) or not (error)."""
    docs = _ddocs(spark, sf_dir)
    mo = _model(spark, sf_dir)
    ident = _ident(spark, sf_dir)
    parsed = (mo.where(F.col("stage") == "entities")
                .select("doc_id", F.from_json(P.json_payload(F.col("raw")), P.ENTITIES_SCHEMA, P._JSON_OPTS)
                        ["entities"].isNotNull().alias("ok")))
    status = parsed.groupBy().agg(F.count("*").alias("total_documents"),
                                  F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("errors"))
    by_src = ident.groupBy("source").agg(F.count("*").alias("n"))
    by_cat = ident.groupBy("category").agg(F.count("*").alias("n"))
    cats = spark.createDataFrame([(c,) for c in vocab.CATEGORIES], "category string")
    by_cat = cats.join(by_cat, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    st = status.select(F.explode(F.array(
        F.struct(F.lit("status").alias("kind"), F.lit("total_documents").alias("key"), F.col("total_documents").alias("n")),
        F.struct(F.lit("status").alias("kind"), F.lit("success").alias("key"), F.col("success").alias("n")),
        F.struct(F.lit("status").alias("kind"), F.lit("errors").alias("key"), F.col("errors").alias("n")))).alias("r")).select("r.*")
    return (st.unionByName(by_src.select(F.lit("source").alias("kind"), F.col("source").alias("key"), "n"))
              .unionByName(by_cat.select(F.lit("category").alias("kind"), F.col("category").alias("key"), "n"))
              .select("kind", "key", F.col("n").cast("bigint").alias("n")))


# ------------------------------------------------------------ ingest, review, audit, retention

RUN_TS = "2026-01-01T00:00:00+00:00"      # run timestamp parameter for audit lines
NOW = "2024-01-31 00:00:00"               # "now" parameter for TTL expiry
LRU_BUDGET = 50 * 1024 * 1024             # byte budget parameter for the LRU query


def html_to_text(spark, sf_dir):
    """A3 + A5 over every page."""
    pages = T.ensure_parallelism(T.pages(spark, sf_dir))
    txt = G.html_to_text(F.col("html"))
    return pages.select("page_id", txt.alias("text"), F.length(txt).cast("bigint").alias("char_count"))


def format_gate(spark, sf_dir):
    """A2 over the derived document names and the page URL file names."""
    files = (_ddocs(spark, sf_dir).select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "filename")
             .unionByName(T.pages(spark, sf_dir).select(
                 F.lit("pages").alias("source"), F.col("page_id").alias("id"),
                 F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1).alias("filename"))))
    return G.format_gate(files).select("source", "id", "filename", "ext", "supported", "reason")


def fingerprint(spark, sf_dir):
    """A5/A6 over every document."""
    return G.fingerprint(_docs(spark, sf_dir))


def audit_events(spark, sf_dir):
    """What happened to each document, content-free: its upload, its
    extraction and its redaction, with hashes, names and counts alone."""
    ts, done = F.lit(RUN_TS), _review_rows(spark, sf_dir)
    docs = done.select("doc_id", "content", "filename", F.size("ents").cast("bigint").alias("found"), F.size(RV.accepted(F.col("ents"), F.col("statuses"))).cast("bigint").alias("active"))
    b = F.encode(F.col("content"), "UTF-8")
    events = F.array(
        F.struct(F.lit("document_uploaded").alias("event"), G.audit_event(ts, "document_uploaded", F.col("doc_id"), file_hash=F.sha2(b, 256), filename=F.col("filename"),
                                                                         file_size_bytes=F.octet_length(b).cast("bigint")).alias("line")),
        F.struct(F.lit("entities_extracted").alias("event"), G.audit_event(ts, "entities_extracted", F.col("doc_id"), entity_count=F.col("found")).alias("line")),
        F.struct(F.lit("document_anonymized").alias("event"), G.audit_event(ts, "document_anonymized", F.col("doc_id"), entity_count=F.col("active")).alias("line")))
    return docs.select("doc_id", F.explode(events).alias("e")).select("doc_id", "e.event", "e.line")


def _cache_entries(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts", "props")
    touched = G.access_touch(ev)
    size = ev.groupBy("doc_id").agg((F.sum(F.length("props")) * 1024).cast("bigint").alias("size_bytes"))
    return touched.join(size, "doc_id")


def ttl_expire(spark, sf_dir):
    """Cache writes (one per logged event) still alive at NOW."""
    ev = T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"), F.col("ts").alias("last_accessed"))
    return G.ttl_live(ev, F.to_timestamp(F.lit(NOW))).select("doc_id", "created_at", "last_accessed")


def lru_evict(spark, sf_dir):
    """Entries kept under the byte budget, newest first."""
    return G.lru_keep(_cache_entries(spark, sf_dir), LRU_BUDGET).select(
        "doc_id", "last_accessed", "size_bytes", F.col("running").cast("bigint").alias("running"))


def _decisions(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type").isin("click", "purchase"), F.lit("accepted"))
               .when(F.col("event_type") == "error", F.lit("removed"))
               .when(F.col("event_type") == "signup", F.lit("proposed")))
    return ev.select(F.col("user_id").alias("doc_id"), ((F.col("event_id") % 20) + 1).cast("int").alias("seq"),
                     status.alias("status"), F.col("ts").alias("decided_at"), "event_id") \
             .where(F.col("status").isNotNull())


def _review_rows(spark, sf_dir):
    """The identified documents, a row each, with ``ents`` and their ``statuses``."""
    rows = _identified(spark, sf_dir)
    ents = F.transform(F.filter("entities", lambda x: x["keep"]), lambda x: F.struct(
        x["e"]["seq"].alias("seq"), x["e"]["value"].alias("value"), x["e"]["category"].alias("category"), x["e"]["entity_type"].alias("entity_type"),
        F.lit(None).cast("string").alias("semantic_role")))
    decisions = _decisions(spark, sf_dir).withColumnRenamed("status", "action")
    return RV.reviewed(rows.withColumn("ents", ents), RV.decision_registers(decisions))


def review_progress(spark, sf_dir):
    """V1 + G8/G12 per document."""
    rows = _review_rows(spark, sf_dir).select("doc_id", F.explode_outer("statuses").alias("status")).where(F.col("status").isNotNull())
    return G.review_progress(rows)


def review_apply(spark, sf_dir):
    """V1 + B12 + R5: redact each document with its accepted entities only."""
    rows = _review_rows(spark, sf_dir).withColumn("active", RV.accepted(F.col("ents"), F.col("statuses"))).where(F.size("active") > 0)
    out = X.anonymize_packed(rows, "active")
    return out.select("doc_id", F.size("mappings").cast("bigint").alias("n_mappings"), "anonymized")


def _bulk_decisions(spark, sf_dir):
    """Every event as a decision; some act on all entities of the document."""
    ev = T.table(spark, sf_dir, "events")
    action = (F.when(F.col("event_id") % 61 == 0, F.lit("remove_all")).when(F.col("event_id") % 37 == 0, F.lit("accept_all"))
               .when(F.col("event_type").isin("click", "purchase"), F.lit("accepted")).when(F.col("event_type") == "error", F.lit("removed"))
               .when(F.col("event_type") == "signup", F.lit("proposed")))
    return ev.select(F.col("user_id").alias("doc_id"), ((F.col("event_id") % 20) + 1).cast("int").alias("seq"), action.alias("action"),
                     F.col("ts").alias("decided_at"), "event_id").where("action is not null")


def review_bulk(spark, sf_dir):
    """V1 + V2: the status of each entity after single decisions and those on all."""
    rows = RV.reviewed(_review_rows(spark, sf_dir).drop("statuses"), RV.decision_registers(_bulk_decisions(spark, sf_dir)))
    rows = rows.withColumn("s", F.arrays_zip(F.col("ents.seq").alias("seq"), F.col("statuses").alias("status")))
    return D.explode_outer_nonnull(rows, "s", ("doc_id",)).select("doc_id", "e.seq", "e.status")


def mapping_write_back(spark, sf_dir):
    """W2 + B12 + D-19: each entity's placeholder once the accepted ones are
    substituted: the real one where its value was, the proposed one elsewhere."""
    rows = _final(spark, sf_dir)
    decisions = _decisions(spark, sf_dir).withColumnRenamed("status", "action")
    rows = RV.reviewed(rows, RV.decision_registers(decisions)).withColumn("active", RV.accepted(F.col("ents"), F.col("statuses")))
    maps = X.number_placeholders(X.greedy_dedup(F.col("active")), F.col("language"))
    rows = rows.withColumn("rows", RV.write_back(F.col("ents"), X.proposed_replacements(F.col("ents"), F.col("language")), maps))
    return D.explode_outer_nonnull(rows, "rows", ("doc_id",)).select("doc_id", "e.seq", "e.original", "e.substitution", "e.semantic_role")


def placeholder_default(spark, sf_dir):
    """The shown placeholder where no proposal came for the contact data."""
    rows = _final(spark, sf_dir)
    shown = X.proposed_replacements(F.col("ents"), F.col("language"))
    some = RC.let(F.struct(F.col("ents"), shown.alias("shown")), lambda r: F.transform(
        r["ents"], lambda e, i: F.when(e["category"] != "dati_contatto", F.get(r["shown"], i))))
    rows = rows.withColumn("s", F.arrays_zip(F.col("ents.seq").alias("seq"), RV.default_placeholders(F.col("ents"), some).alias("substitution")))
    return D.explode_outer_nonnull(rows, "s", ("doc_id",)).select("doc_id", "e.seq", "e.substitution")


LOOKUP_TTL = 6 * 3600                     # lifetime parameter for the lookup query


def document_lookup(spark, sf_dir):
    """D-23: views and clicks as requests for documents that sign-ups store."""
    ev = T.table(spark, sf_dir, "events")
    stored = ev.where("event_type = 'signup'").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("created_at"))
    asked = ev.where("event_type in ('view', 'click')").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("doc_id"), F.col("ts").alias("at"))
    return LK.look_up(asked, stored, LOOKUP_TTL).select("request_id", "doc_id", "created_at", "reason")


# ------------------------------------------------------------ extract runs

RUN_ID, MODEL_NAME = "20260101T000000Z", "rules"


def _extract_digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "status", "error", F.col("doc_language").alias("language"), F.col("doc_type").alias("document_type"),
                       F.size("extracted").cast("bigint").alias("entities_count"), F.to_json("extracted", {"ignoreNullFields": "false"}).alias("entities"))


def extract_pipeline(spark, sf_dir):
    """R8 + J4 + G10 + B16: the derived documents end to end, language detected."""
    docs = DV.documents(spark, sf_dir).drop("language")
    rows = EX.extract(docs, DV.model_outputs(spark, sf_dir), partitions=DV.partitions(spark, sf_dir))
    return _extract_digest(rows)


PROMPT_LIMIT = 8000                       # characters the stand-in model reads


def mail_model():
    """A stand-in for a model: names the e-mail addresses of a prompt; longer prompts than it reads are an error."""
    import json
    import re
    address = re.compile(R.STRUCTURAL[0].pattern)

    def answer(prompts):
        if any(len(p) > PROMPT_LIMIT for p in prompts):
            raise ValueError("prompt too long")
        return [json.dumps({"entities": [{"value": v, "category": "dati_contatto", "entity_type": "indirizzo_email"} for v in address.findall(p)]}) for p in prompts]
    return answer


def _asked_documents(spark, sf_dir):
    """The real documents, the stand-in model's outputs for them, and the partitions to deal both over."""
    docs = T.documents(spark, sf_dir).select("doc_id", "content")
    partitions = T.partitions_for(docs)
    prompts = _spread(docs, partitions).select("doc_id", MD.entity_prompt(F.col("content")).alias("prompt"))
    return docs, MD.run_model(prompts, mail_model, "entities", retries=0), partitions


def model_hook(spark, sf_dir):
    """C21 + J1: what the model's answers hold per document, failures as rows."""
    _, out, _ = _asked_documents(spark, sf_dir)
    lists = RC.model_lists(out)
    return lists.select("doc_id", F.size("llm").cast("bigint").alias("n_entities"), F.col("model_error").alias("error"))


def extract_documents(spark, sf_dir):
    """R8 over the real documents, their model outputs from the hook; a document
    the model can't read stays a row with its error."""
    docs, out, partitions = _asked_documents(spark, sf_dir)
    return _extract_digest(EX.extract(docs, out, recognizers=R.STRUCTURAL, partitions=partitions))


def run_records(spark, sf_dir):
    """V5 + S6: the run records of the real documents, flattened for comparison."""
    docs, out, partitions = _asked_documents(spark, sf_dir)
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rec = EX.run_records(EX.extract(docs, out, recognizers=R.STRUCTURAL, partitions=partitions), RUN_ID, RUN_TS, MODEL_NAME, name)
    return rec.select("run_id", "document", "document_id", "char_count", "status", "error", F.col("extraction.entities_count").alias("entities_count"),
                      F.col("anonymization.mappings_count").alias("mappings_count"), F.col("anonymization.anonymized_preview").alias("preview"))


def _overrides(doc_id):
    return F.when(doc_id % 7 == 0, F.lit("legal")).when(doc_id % 7 == 1, F.lit("contract")).when(doc_id % 7 == 2, F.lit("sconosciuto"))


def type_override_rerun(spark, sf_dir):
    """V3 + B14: the roles of the documents whose type an override changes."""
    rows = RC.with_roles(_identified(spark, sf_dir).withColumn("asked", _overrides(F.col("doc_id"))), override_col="asked")
    changed = rows.where(~F.col("doc_type").eqNullSafe(C.detect_doc_type(F.col("content"))))
    return RC.entity_rows(changed, "doc_type", semantic_role="role").select("doc_id", "seq", "value", "semantic_role", "doc_type")


# ------------------------------------------------------------ detector options

def category_filter(spark, sf_dir):
    """B1: only the requested categories."""
    return D.detect(_docs(spark, sf_dir), categories=["dati_contatto", "dati_finanziari"]).select("doc_id", "seq", "value", "category", "entity_type")


def keep_fn_filter(spark, sf_dir):
    """B5 layer 3: a user's test drops names whose words are equally long."""
    def keep(values, entity_types, languages):
        words = values.str.split()
        return ~((entity_types == "nome_cognome") & (words.str[0].str.len() == words.str[-1].str.len()))

    return D.detect(_ddocs(spark, sf_dir), keep_fn=keep).select("doc_id", "seq", "value", "entity_type")


def _identifiers(spark, sf_dir):
    return _spread(DV.identifiers(spark, sf_dir), DV.partitions(spark, sf_dir))


ID_TYPES = ("IT_LICENSE_PLATE", "IT_IDENTITY_CARD", "IT_IDENTITY_CARD_ELECTRONIC", "CH_AVS_NUMBER", "IT_PARTITA_IVA", "MEDICAL_LICENSE", "CRYPTO", "NRP")


def detect_ids_ch_it(spark, sf_dir):
    """Identity cards, plates, social insurance, VAT, licences, wallets, codes."""
    return D.detect(_identifiers(spark, sf_dir), recognizers=_recs(*ID_TYPES)).select("doc_id", "seq", "value", "category", "entity_type", "confidence")


def context_boost(spark, sf_dir):
    """C17: the identifiers whose score a word of context before them raised."""
    base = {}
    for r in _recs(*ID_TYPES):
        base.setdefault({t: e for t, _, e in vocab.DETECTOR_TYPE_MAP}[r.detector_type], set()).add(r.score)
    hits = detect_ids_ch_it(spark, sf_dir)
    raised = F.lit(False)
    for kind, scores in base.items():
        raised = raised | ((F.col("entity_type") == kind) & ~F.col("confidence").isin(sorted(scores)))
    return hits.where(raised).select("doc_id", "seq", "value", "entity_type", "confidence")


def detect_iban_mod97(spark, sf_dir):
    """Account numbers whose check digits hold."""
    return D.detect(_identifiers(spark, sf_dir), recognizers=_recs("IBAN_CODE")).select("doc_id", "seq", "value", "entity_type")


# Recognisers as wide as a statistical model's: what B4, B6 and B7 are there to narrow.
WIDE = [R.Recognizer("DATE_TIME", r"\b[0-9]{1,2} anni\b|\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b", 0.6, needs_digit=True),
        R.Recognizer("NRP", r"\b[A-Z]{6}[0-9]{2}A[0-9]{2}H[0-9A-Z]{4}\b", 0.6, needs_digit=True),
        R.Recognizer("PERSON", r"fiscale [A-Z]{6}[0-9]{2}A[0-9]{2}H[0-9]{3}[A-Z]\b", 0.6),
        R.Recognizer("PERSON", r"\b[A-Z]{6}[0-9]{2}A[0-9]{2}H[0-9]{3}[A-Z]\s", 0.6)]


def wide_filters(spark, sf_dir):
    """A wide detector's codes and dates, narrowed to real ones."""
    return D.detect(_identifiers(spark, sf_dir), recognizers=WIDE).select("doc_id", "seq", "value", "category", "entity_type")


# ------------------------------------------------------------ prompts (model input side)

def entity_prompts(spark, sf_dir):
    """C21 input: the entity-extraction message of every derived document."""
    return _ddocs(spark, sf_dir).select("doc_id", MD.entity_prompt(F.col("content")).alias("prompt"))


def role_prompts(spark, sf_dir):
    """J5 + B13: the role-stage message for documents that have actors."""
    rows = _identified(spark, sf_dir).withColumn("actors", F.transform(F.filter("entities", lambda x: x["keep"] & RO.is_actor(
        x["e"]["category"], x["e"]["entity_type"])), lambda x: x["e"])).where(F.size("actors") > 0)
    return rows.select("doc_id", MD.role_prompt(F.col("actors"), F.col("content")).alias("prompt"))


def ownership_prompts(spark, sf_dir):
    """J5 + B13: the ownership message of documents with roles and data without an owner."""
    of = lambda entities, test: F.transform(F.filter(entities, lambda x: x["keep"] & test(x)), lambda x: F.struct(
        x["e"]["value"].alias("value"), x["e"]["entity_type"].alias("entity_type"), x["remapped"].alias("semantic_role")))
    prompts = RC.let(F.struct(F.col("entities"), F.col("content")), lambda r: RC.let(
        F.struct(of(r["entities"], lambda x: x["actor"] & x["remapped"].isNotNull()).alias("with_role"),
                 of(r["entities"], lambda x: ~x["actor"] & x["remapped"].isNull()).alias("no_owner")),
        lambda s: F.when((F.size(s["with_role"]) > 0) & (F.size(s["no_owner"]) > 0), F.array(
            MD.ownership_prompt(s["with_role"], s["no_owner"], r["content"])))))
    # A document's prompt is an array of one: a filter on the arrays it is made of would be
    # pushed below the role passes, which would then run once for each of its terms.
    rows = _roles(spark, sf_dir).withColumn("prompts", prompts)
    return D.explode_outer_nonnull(rows, "prompts", ("doc_id",), alias="prompt")


def _with_conf(fn):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_runtime_conf(spark)
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    q.__name__ = getattr(fn, "__name__", "query")
    q.__doc__ = fn.__doc__
    return q


# ------------------------------------------------------------ corpus listing, run ids

def corpus_prefix(spark, sf_dir):
    """A4 + A5: derived documents whose file name starts with a prefix, in
    file-name order, with their character counts."""
    d = _ddocs(spark, sf_dir).where(F.col("filename").startswith("doc_1"))
    return d.select("filename", F.length("content").cast("bigint").alias("char_count")).orderBy("filename")


def run_ids(spark, sf_dir):
    """Run ids ``yyyyMMdd'T'HHmmss'Z'`` of every logged event (UTC)."""
    ev = T.table(spark, sf_dir, "events")      # ts is TIMESTAMP_NTZ holding UTC wall time
    return ev.select("event_id", IO.run_id_of(F.col("ts")).alias("run_id"))


def queries() -> dict:
    return {k: _with_conf(v) for k, v in _queries().items()}


def _queries() -> dict:
    return {
        "redact_emails": _redact(("EMAIL_ADDRESS",)),
        "detect_email": _detect_only(("EMAIL_ADDRESS",)),
        "detect_phone": _detect_only(("PHONE_NUMBER",)),
        "detect_ip": _detect_only(("IP_ADDRESS",)),
        "detect_card_luhn": _detect_only(("CREDIT_CARD",)),
        "detector_only_run": detector_only_run,
        "count_by_category": count_by_category,
        "dedup_detected": dedup_detected,
        "redact_documents": _redact(),
        "parse_model_entities": parse_model_entities,
        "clean_values": clean_values,
        "reject_bundled": reject_bundled,
        "type_alias": type_alias,
        "parse_assignments": parse_assignments,
        "parse_ownership": parse_ownership,
        "false_positive_filter": false_positive_filter,
        "overlap_join": overlap_join,
        "merge_semantic": _survivors(True),
        "merge_structural": _survivors(False),
        "url_in_email": url_in_email,
        "date_dedup": date_dedup,
        "legal_suffix": legal_suffix,
        "legal_context": legal_context,
        "fiscal_code_validate": fiscal_code_validate,
        "institutions": institutions,
        "identify": identify,
        "doc_type": doc_type,
        "language_detect": language_detect,
        "assign_roles": assign_roles,
        "role_remap": role_remap,
        "ownership": ownership,
        "propagate_same_type": propagate_same_type,
        "propagate_proximity": propagate_proximity,
        "roles_final": roles_final,
        "label_choice": label_choice,
        "label_localise": label_localise,
        "greedy_dedup": greedy_dedup,
        "number_placeholders": number_placeholders,
        "preview_numbers": preview_numbers,
        "redact_derived": _redact_final(False),
        "redact_isolated": _redact_final(True),
        "redact_conversations": redact_conversations,
        "eval_strict": eval_strict,
        "eval_lenient": eval_lenient,
        "eval_grouping_sets": eval_grouping_sets,
        "run_summary": run_summary,
        "html_to_text": html_to_text,
        "format_gate": format_gate,
        "fingerprint": fingerprint,
        "audit_events": audit_events,
        "ttl_expire": ttl_expire,
        "lru_evict": lru_evict,
        "review_progress": review_progress,
        "review_apply": review_apply,
        "entity_prompts": entity_prompts,
        "role_prompts": role_prompts,
        "ownership_prompts": ownership_prompts,
        "model_hook": model_hook,
        "extract_pipeline": extract_pipeline,
        "extract_documents": extract_documents,
        "run_records": run_records,
        "type_override_rerun": type_override_rerun,
        "entity_counts": entity_counts,
        "eval_sorted_report": eval_sorted_report,
        "eval_skipped": eval_skipped,
        "review_bulk": review_bulk,
        "mapping_write_back": mapping_write_back,
        "placeholder_default": placeholder_default,
        "document_lookup": document_lookup,
        "category_filter": category_filter,
        "keep_fn_filter": keep_fn_filter,
        "detect_ids_ch_it": detect_ids_ch_it,
        "detect_iban_mod97": detect_iban_mod97,
        "context_boost": context_boost,
        "wide_filters": wide_filters,
        "corpus_prefix": corpus_prefix,
        "run_ids": run_ids,
    }
