"""Reconciling the two detectors (G1, D-1 ... D-12, B8, C18).

Entity tables are ``(doc_id, seq, value, category, entity_type, confidence,
source)``.  Every join is keyed on ``doc_id`` (equi part) with the
substring conditions as residual predicates, so Spark plans them as
sort-merge joins over entity rows -- the document text never travels with
them.  The work inside one ``doc_id`` is bounded by that document's own
entities, which a single text row bounds.

The two steps that need the text (legal-context search D-12 and the
institution finder C18) join the entity side to the documents on
``doc_id``; write both tables bucketed by ``doc_id`` (see
``sources.tables.write_bucketed``) and that join needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import ustrip
from .containment import contains_pairs
from pyspark.sql import Column

ENTITY_COLS = ["doc_id", "seq", "value", "category", "entity_type", "confidence", "source"]


def dedup_detected(ner: DataFrame) -> DataFrame:
    """G1: per (doc, lower(value), entity_type) keep the highest confidence
    (null = 0; earliest on ties), placed at the key's first position."""
    key = Window.partitionBy("doc_id", F.lower("value"), "entity_type")
    ranked = (ner.withColumn("first_seq", F.min("seq").over(key))
                 .withColumn("rn", F.row_number().over(
                     key.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "seq"))))
    return ranked.where("rn = 1").withColumn("seq", F.col("first_seq")).select(*ENTITY_COLS)


def _contains(hay, needle):
    return F.instr(hay, needle) > 0


def overlap_pairs(ner: DataFrame, llm: DataFrame) -> DataFrame:
    """D-1: (pattern entity, model entity) pairs of one document whose lower
    values are substring-related in either direction."""
    n = ner.select("doc_id", F.col("seq").alias("nseq"), F.col("value").alias("nval"),
                   F.col("category").alias("ncat"), F.col("entity_type").alias("ntype"),
                   F.lower("value").alias("nlow"), F.lower(ustrip(F.col("value"))).alias("nslow"))
    m = llm.select(F.col("doc_id").alias("ldoc"), F.col("seq").alias("lseq"), F.col("value").alias("lval"),
                   F.col("category").alias("lcat"), F.col("entity_type").alias("ltype"),
                   F.lower("value").alias("llow"), F.lower(ustrip(F.col("value"))).alias("lslow"))
    # anchored containment joins in both directions (no all-pairs scan per
    # document), then one row per (pattern entity, model entity)
    m = m.withColumnRenamed("ldoc", "doc_id")
    n_in_l = contains_pairs(m, n, ["doc_id"], "llow", "nlow")
    l_in_n = contains_pairs(n, m, ["doc_id"], "nlow", "llow")
    cols = ["doc_id", "nseq", "nval", "ncat", "ntype", "nlow", "nslow", "lseq", "lval", "lcat", "ltype", "llow", "lslow"]
    return n_in_l.select(*cols).unionByName(l_in_n.select(*cols)).dropDuplicates(["doc_id", "nseq", "lseq"])


def merge_flags(ner: DataFrame, llm: DataFrame) -> DataFrame:
    """Per pattern entity: the facts the merge rules need, from its overlaps."""
    p = overlap_pairs(ner, llm)
    return p.groupBy("doc_id", "nseq").agg(
        F.lit(True).alias("has_overlap"),
        # D-3: standalone place inside a longer model address / birth place / zip-city
        F.bool_or(F.col("ltype").isin("indirizzo", "luogo_nascita", "cap_citta")
                  & _contains(F.col("llow"), F.col("nslow")) & (F.col("nslow") != F.col("llow"))
                  ).alias("inside_place"),
        # D-4: strict fragment of a different-category model entity
        F.bool_or((F.col("lcat") != F.col("ncat")) & _contains(F.col("llow"), F.col("nslow"))
                  & (F.col("nslow") != F.col("llow"))).alias("fragment"),
        # D-5: strict substring of a same-type model entity
        F.bool_or((F.col("ltype") == F.col("ntype")) & (F.col("nslow") != F.col("lslow"))
                  & _contains(F.col("lslow"), F.col("nslow"))).alias("same_type_substr"),
        # D-6: exact value matches, all of another category
        F.count_if(F.col("lslow") == F.col("nslow")).alias("n_exact"),
        F.count_if((F.col("lslow") == F.col("nslow")) & (F.col("lcat") == F.col("ncat"))).alias("n_exact_same_cat"),
        # D-7: a same-type model entity already covers it
        F.bool_or(F.col("ltype") == F.col("ntype")).alias("same_type_overlap"),
        # D-8: URL fragment of a model e-mail
        F.bool_or((F.col("ltype") == "email") & _contains(F.col("llow"), F.col("nlow"))).alias("in_email"),
    )


def pattern_survivors(ner: DataFrame, llm: DataFrame) -> DataFrame:
    """D-2 ... D-8: the pattern entities the merge adds (source 'merged')."""
    ner = dedup_detected(ner)
    # flags derive from ner (same doc_id attribute): rename before joining back
    flags = merge_flags(ner, llm).withColumnRenamed("doc_id", "fdoc")
    j = ner.join(flags, (F.col("doc_id") == F.col("fdoc")) & (F.col("seq") == F.col("nseq")), "left") \
           .drop("fdoc")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    semantic = F.col("entity_type").isin(vocab.SEMANTIC_MERGE_TYPES)
    standalone = ((F.col("entity_type") == "indirizzo")
                  & ~ustrip(F.col("value")).rlike(r"[,0-9]") & f("inside_place"))
    exact_conflict = (F.coalesce("n_exact", F.lit(0)) > 0) & (F.coalesce("n_exact_same_cat", F.lit(0)) == 0)
    keep_semantic = f("has_overlap") & ~standalone & ~f("fragment") & ~f("same_type_substr") & ~exact_conflict
    keep_structural = ~f("same_type_overlap") & ~((F.col("entity_type") == "url") & f("in_email"))
    kept = j.where(F.when(semantic, keep_semantic).otherwise(keep_structural))
    return kept.select("doc_id", "seq", "value", "category", "entity_type", "confidence",
                       F.lit("merged").alias("source"))


def merge(ner: DataFrame, llm: DataFrame) -> DataFrame:
    """D-9 + D-10: model entities first (their order), then surviving pattern
    entities (detector order); seq is re-based to 1..n per document; dates
    already present as a person's birth date are dropped from dati_temporali."""
    both = (llm.select(*ENTITY_COLS).withColumn("part", F.lit(0))
            .unionByName(pattern_survivors(ner, llm).withColumn("part", F.lit(1))))
    w = Window.partitionBy("doc_id").orderBy("part", "seq")
    both = both.withColumn("seq", F.row_number().over(w)).drop("part")
    key = F.lower(ustrip(F.col("value")))
    births = (both.where((F.col("category") == "persone_fisiche") & (F.col("entity_type") == "data_nascita"))
                  .select(F.col("doc_id").alias("bdoc"), key.alias("bkey")).distinct())
    tmp = both.withColumn("k", key)
    dup = (tmp["category"] == "dati_temporali") & (tmp["doc_id"] == births["bdoc"]) & (tmp["k"] == births["bkey"])
    return tmp.join(births, dup, "left_anti").drop("k").select(*ENTITY_COLS)


CORPORATE_SUFFIX_RE = (r"(?iu)\b(?:" + "|".join(vocab.CORPORATE_SUFFIXES) + r")(?:\b|\s|$|[,;.)])")


def occurrences(text_lower: Column, needle: Column) -> Column:
    """1-based starts of all occurrences of ``needle``, overlapping ones too.

    Only a needle with a border (a prefix that is its suffix) can overlap
    itself; then at most its length times as many occurrences exist."""
    ln = F.length(needle)
    n = F.when(ln > 0, ((F.length(text_lower) - F.length(F.replace(text_lower, needle, F.lit("")))) / ln)
               .cast("int")).otherwise(F.lit(0))
    border = (ln > 1) & F.exists(F.sequence(F.lit(1), F.greatest(ln - 1, F.lit(1))), lambda k: F.substring(
        needle, F.lit(1), ln - k) == F.substring(needle, k + 1, ln))
    n = F.when(border, n * ln).otherwise(n)
    init = F.struct(F.lit(1).alias("nxt"), F.array().cast("array<int>").alias("out"))

    def step(acc, i):
        p = F.instr(F.substring(text_lower, acc["nxt"], 1 << 30), needle) + acc["nxt"] - 1
        found = p >= acc["nxt"]
        return F.struct(F.when(found, p + 1).otherwise(acc["nxt"]).alias("nxt"),
                        F.when(found, F.array_append(acc["out"], p)).otherwise(acc["out"]).alias("out"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), init, step)["out"]) \
            .otherwise(F.array().cast("array<int>"))


def legal_context_hit(text: Column, value: Column) -> Column:
    """D-12 on lower-cased ``text`` and ``value`` columns (plain column
    references: they are read inside lambdas, once per occurrence and
    window): a legal phrase within 200 characters before or after an
    occurrence of the value (case-insensitive, across lines) -- the regex
    ``phrase.{0,200}value|value.{0,200}phrase`` evaluated as window tests
    around each occurrence, without compiling a pattern per row."""
    lc, lv = text, value          # callers pass lower-cased plain columns
    ln = F.length(lv)
    win = vocab.LEGAL_CONTEXT_WINDOW

    def near(p):
        hit = F.lit(False)
        for ph in vocab.LEGAL_CONTEXT_PHRASES:
            lp = len(ph)
            lo = F.greatest(p - win - lp, F.lit(1))
            before = F.substring(lc, lo, p - lo)
            after = F.substring(lc, p + ln, win + lp)
            hit = hit | (F.instr(before, ph.lower()) > 0) | (F.instr(after, ph.lower()) > 0)
        return hit

    return F.exists(occurrences(lc, lv), near)


def reclassify_legal(entities: DataFrame, docs: DataFrame, text_col: str = "content") -> DataFrame:
    """D-11/D-12: persone_fisiche entities with a corporate suffix, or found
    near a legal phrase in their document, become persone_giuridiche /
    nome_azienda.  Only person rows are joined to the text."""
    person = F.col("category") == "persone_fisiche"
    suffix = person & F.col("value").rlike(CORPORATE_SUFFIX_RE)
    e = entities.withColumn("by_suffix", suffix)
    cand = e.where(person & ~F.col("by_suffix")).select("doc_id", "seq", "value")
    d = docs.select(F.col("doc_id").alias("ddoc"), F.col(text_col).alias("text"))
    near = (cand.join(d, cand["doc_id"] == d["ddoc"], "inner")
                .withColumn("lc", F.lower("text")).withColumn("lv", F.lower("value"))
                .where(legal_context_hit(F.col("lc"), F.col("lv")))
                .select(F.col("doc_id").alias("ndoc"), F.col("seq").alias("nseq"), F.lit(True).alias("by_context")))
    j = e.join(near, (e["doc_id"] == near["ndoc"]) & (e["seq"] == near["nseq"]), "left")
    flip = F.col("by_suffix") | F.coalesce("by_context", F.lit(False))
    return j.select("doc_id", "seq", "value",
                    F.when(flip, F.lit("persone_giuridiche")).otherwise(F.col("category")).alias("category"),
                    F.when(flip, F.lit("nome_azienda")).otherwise(F.col("entity_type")).alias("entity_type"),
                    "confidence", "source")


def validate_fiscal_code(entities: DataFrame) -> DataFrame:
    """Drop codice_fiscale entities that are not a well-formed code."""
    bad = (F.col("entity_type") == "codice_fiscale") & ~ustrip(F.col("value")).rlike(vocab.FISCAL_CODE_PATTERN)
    return entities.where(~bad)


# \w spelled out as letters/digits/underscore so Java and RE2 agree on
# accented names ("Universität München").
INSTITUTION_RE = "(?:" + "|".join(vocab.INSTITUTION_ALTERNATIVES).replace(r"\w", r"[\p{L}\p{N}_]") + ")"


def institution_candidates(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """Narrow step on the documents: institution names in text order."""
    return docs.select("doc_id", F.transform(F.regexp_extract_all(F.col(text_col), F.lit(INSTITUTION_RE), 0),
                                             lambda v: ustrip(v)).alias("found"))


def add_institutions(entities: DataFrame, docs: DataFrame, text_col: str = "content") -> DataFrame:
    """Append institutions not equal to / inside a known value; a find
    also suppresses later finds (ordered fold)."""
    known = entities.groupBy("doc_id").agg(
        F.collect_list(F.lower("value")).alias("known"), F.max("seq").alias("max_seq"))
    cand = institution_candidates(docs, text_col).where(F.size("found") > 0)
    j = cand.join(known, "doc_id", "left")
    empty = F.array().cast("array<string>")

    def step(acc, v):
        lv = F.lower(v)
        skip = F.exists(acc["seen"], lambda s: F.instr(s, lv) > 0)
        return F.struct(F.when(skip, acc["seen"]).otherwise(F.array_append(acc["seen"], lv)).alias("seen"),
                        F.when(skip, acc["added"]).otherwise(F.array_append(acc["added"], v)).alias("added"))

    init = F.struct(F.coalesce(F.col("known"), empty).alias("seen"), empty.alias("added"))
    added = j.select("doc_id", F.coalesce("max_seq", F.lit(0)).alias("base"),
                     F.aggregate("found", init, step)["added"].alias("added"))
    new = (added.select("doc_id", "base", F.posexplode_outer("added").alias("i", "value"))
                .where(F.col("value").isNotNull())
                .select("doc_id", (F.col("base") + F.col("i") + 1).cast("int").alias("seq"), "value",
                        F.lit("persone_giuridiche").alias("category"),
                        F.lit("nome_organizzazione").alias("entity_type"),
                        F.lit(vocab.INSTITUTION_CONFIDENCE).alias("confidence"),
                        F.lit("ner").alias("source")))
    return entities.select(*ENTITY_COLS).unionByName(new)


def identify(ner: DataFrame, llm: DataFrame, docs: DataFrame, text_col: str = "content") -> DataFrame:
    """Stage order: merge -> legal reclassification -> fiscal-code check ->
    institutions (which are never reclassified)."""
    e = merge(ner, llm)
    e = reclassify_legal(e, docs, text_col)
    e = validate_fiscal_code(e)
    return add_institutions(e, docs, text_col)
