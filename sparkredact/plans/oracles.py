"""DuckDB SQL twins of the registered queries (the driver's correctness gate)."""

from __future__ import annotations

import re

from .. import vocab
from ..functions import recognizers as R
from ..sources import derived as DV
from . import duck as S

ENT_T = ("STRUCT(seq INTEGER, value VARCHAR, category VARCHAR, entity_type VARCHAR, "
         "semantic_role VARCHAR)")


def _recs(*types):
    return [r for r in R.DEFAULT_RECOGNIZERS if r.detector_type in types]


def _docs_cte() -> str:
    return "docs AS (SELECT doc_id, text AS content, lang AS language FROM documents)"


def _detected(recs=None) -> str:
    return (f"WITH {_docs_cte()}, det AS (SELECT doc_id, content, language, "
            f"{S.detected_array('content', 'language', None, recs)} AS detected FROM docs)")


def _detect_only(types) -> str:
    return (_detected(_recs(*types)) +
            " SELECT doc_id, e.seq AS seq, e.value AS value, e.category AS category, "
            "e.entity_type AS entity_type, e.confidence AS confidence "
            "FROM (SELECT doc_id, unnest(detected) AS e FROM det)")


def detector_only_run() -> str:
    return (_detected().replace("lang AS language", f"{_language_sql('text')} AS language") +
            " SELECT doc_id, e.seq AS seq, e.value AS value, e.category AS category, "
            "e.entity_type AS entity_type, e.confidence AS confidence, e.source AS source "
            "FROM (SELECT doc_id, unnest(detected) AS e FROM det)")


def count_by_category() -> str:
    cats = ", ".join(f"({S.q(c)})" for c in vocab.CATEGORIES)
    return (_detected() +
            f", ents AS (SELECT e.category AS category FROM (SELECT unnest(detected) AS e FROM det)) "
            f"SELECT c.category AS category, count(ents.category)::BIGINT AS n_entities "
            f"FROM (VALUES {cats}) c(category) LEFT JOIN ents ON ents.category = c.category "
            f"GROUP BY c.category")


def dedup_detected() -> str:
    # G1 in SQL: rank within (doc, lower(value), type) by confidence desc, seq;
    # the kept row takes the key's first seq.
    return (_detected() +
            ", ents AS (SELECT doc_id, e.* FROM (SELECT doc_id, unnest(detected) AS e FROM det)) "
            "SELECT doc_id, first_seq AS seq, value, entity_type, confidence FROM ("
            " SELECT *, min(seq) OVER (PARTITION BY doc_id, lower(value), entity_type) AS first_seq,"
            " row_number() OVER (PARTITION BY doc_id, lower(value), entity_type "
            "   ORDER BY coalesce(confidence, 0) DESC, seq) AS rn FROM ents) WHERE rn = 1")


def _redact(types=None) -> str:
    recs = _recs(*types) if types else R.unconfirmed_safe()
    ents = ("list_transform(detected, lambda e: {'seq': e.seq, 'value': e.value, 'category': e.category, "
            "'entity_type': e.entity_type, 'semantic_role': NULL::VARCHAR})")
    lang = "coalesce(nullif(language, ''), 'it')"
    maps = S.number_placeholders(S.greedy_dedup("ents", ENT_T), lang)
    return (_detected(recs) +
            f", e AS (SELECT doc_id, content, language, {ents} AS ents FROM det), "
            f"m AS (SELECT doc_id, content, {maps} AS mappings FROM e) "
            f"SELECT doc_id, len(mappings)::BIGINT AS n_mappings, "
            f"{S.substitute('content', 'mappings')} AS anonymized FROM m")


ITEM_T = "STRUCT(value VARCHAR, category VARCHAR, entity_type VARCHAR)"


def _items_cte() -> str:
    return (f"WITH mo AS ({DV.model_sql()}), items AS (SELECT doc_id, pos, it.value AS raw_value, "
            f"it.category AS category, it.entity_type AS raw_type "
            f"FROM {S.parsed_items('mo', 'entities', 'entities', ITEM_T)})")


def parse_model_entities() -> str:
    cats = "(" + ", ".join(S.q(c) for c in vocab.CATEGORIES) + ")"
    return (_items_cte() +
            f", c AS (SELECT *, {S.clean_model_value('raw_value')} AS value FROM items) "
            f"SELECT doc_id, (pos + 1)::INTEGER AS seq, value, category, {S.canonical_type('raw_type')} AS entity_type "
            f"FROM c WHERE category IN {cats} AND raw_value IS NOT NULL AND {S.reject_reason('value')} IS NULL")


def clean_values() -> str:
    return (_items_cte() + f" SELECT doc_id, pos, raw_value, {S.clean_model_value('raw_value')} AS value "
            "FROM items WHERE raw_value IS NOT NULL")


def reject_bundled() -> str:
    return (_items_cte() + f", c AS (SELECT doc_id, pos, {S.clean_model_value('raw_value')} AS value "
            "FROM items WHERE raw_value IS NOT NULL) "
            f"SELECT doc_id, pos, value, {S.reject_reason('value')} AS reason FROM c "
            f"WHERE {S.reject_reason('value')} IS NOT NULL")


def type_alias() -> str:
    return _items_cte() + f" SELECT doc_id, pos, raw_type, {S.canonical_type('raw_type')} AS entity_type FROM items"


def _value_map(stage: str, field: str, role_field: str, out: str) -> str:
    st = f"STRUCT(value VARCHAR, {role_field} VARCHAR)"
    return (f"WITH mo AS ({DV.model_sql()}), r AS (SELECT doc_id, pos, "
            f"{S.ustrip('coalesce(it.value, ' + chr(39) + chr(39) + ')')} AS value, "
            f"{S.role_normal_form('coalesce(it.' + role_field + ', ' + chr(39) + chr(39) + ')')} AS role "
            f"FROM {S.parsed_items('mo', stage, field, st)}) "
            f"SELECT doc_id, value, max_by(role, pos) AS {out} FROM r "
            f"WHERE length(value) > 0 AND length(role) > 0 GROUP BY doc_id, value")


def oracle_sql() -> dict:
    return {
        "redact_emails": _redact(("EMAIL_ADDRESS",)),
        "detect_email": _detect_only(("EMAIL_ADDRESS",)),
        "detect_phone": _detect_only(("PHONE_NUMBER",)),
        "detect_ip": _detect_only(("IP_ADDRESS",)),
        "detect_card_luhn": _detect_only(("CREDIT_CARD",)),
        "detector_only_run": detector_only_run(),
        "count_by_category": count_by_category(),
        "dedup_detected": dedup_detected(),
        "redact_documents": _redact(),
        "parse_model_entities": parse_model_entities(),
        "clean_values": clean_values(),
        "reject_bundled": reject_bundled(),
        "type_alias": type_alias(),
        "parse_assignments": _value_map("roles", "assignments", "role", "role"),
        "parse_ownership": _value_map("ownership", "ownership", "owner_role", "owner_role"),
        **merge_oracles(),
        **classify_oracles(),
        **role_oracles(),
        **label_oracles(),
        **eval_oracles(),
        **governance_oracles(),
        **prompt_oracles(),
        **extract_oracles(),
        **review_oracles(),
        **option_oracles(),
        "corpus_prefix": (f"WITH dd AS ({DV.docs_sql()}) SELECT filename, length(content)::BIGINT AS char_count "
                          "FROM dd WHERE starts_with(filename, 'doc_1') ORDER BY filename"),
        "run_ids": "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id FROM events",
    }


# ------------------------------------------------------------ merge stage (SQL)

def _merge_ctes(docs: str | None = None, model: str | None = None, recognizers=None) -> str:
    """From ``docs`` (doc_id, content, language) and ``model`` (doc_id, stage, raw), the derived ones by default."""
    from ..operators import merge as M
    cats = "(" + ", ".join(S.q(c) for c in vocab.CATEGORIES) + ")"
    sem = "(" + ", ".join(S.q(t) for t in vocab.SEMANTIC_MERGE_TYPES) + ")"
    us = S.ustrip
    return f"""WITH dd AS ({docs or DV.docs_sql()}),
    det AS (SELECT doc_id, content, language, {S.detected_array('content', 'language', None, recognizers)} AS detected FROM dd),
    ner AS (SELECT doc_id, e.seq AS seq, e.value AS value, e.category AS category, e.entity_type AS entity_type,
                   e.confidence AS confidence, e.source AS source FROM (SELECT doc_id, unnest(detected) AS e FROM det)),
    mo AS ({model or DV.model_sql()}),
    items AS (SELECT doc_id, pos, it.value AS raw_value, it.category AS category, it.entity_type AS raw_type
              FROM {S.parsed_items('mo', 'entities', 'entities', ITEM_T)}),
    cl AS (SELECT *, {S.clean_model_value('raw_value')} AS value FROM items),
    llm AS (SELECT doc_id, (pos + 1)::INTEGER AS seq, value, category, {S.canonical_type('raw_type')} AS entity_type,
                   NULL::DOUBLE AS confidence, 'llm' AS source
            FROM cl WHERE category IN {cats} AND raw_value IS NOT NULL AND {S.reject_reason('value')} IS NULL),
    g1 AS (SELECT doc_id, first_seq AS seq, value, category, entity_type, confidence, source FROM (
             SELECT *, min(seq) OVER (PARTITION BY doc_id, lower(value), entity_type) AS first_seq,
                    row_number() OVER (PARTITION BY doc_id, lower(value), entity_type
                                       ORDER BY coalesce(confidence, 0) DESC, seq) AS rn FROM ner) WHERE rn = 1),
    pairs AS (SELECT n.doc_id, n.seq AS nseq, l.seq AS lseq, n.value AS nval, n.category AS ncat, n.entity_type AS ntype,
                     lower(n.value) AS nlow, lower({us('n.value')}) AS nslow,
                     l.category AS lcat, l.entity_type AS ltype, lower(l.value) AS llow, lower({us('l.value')}) AS lslow
              FROM g1 n JOIN llm l ON n.doc_id = l.doc_id
               AND (instr(lower(l.value), lower(n.value)) > 0 OR instr(lower(n.value), lower(l.value)) > 0)),
    flags AS (SELECT doc_id, nseq,
                bool_or(ltype IN ('indirizzo', 'luogo_nascita', 'cap_citta') AND instr(llow, nslow) > 0 AND nslow <> llow) AS inside_place,
                bool_or(lcat <> ncat AND instr(llow, nslow) > 0 AND nslow <> llow) AS fragment,
                bool_or(ltype = ntype AND nslow <> lslow AND instr(lslow, nslow) > 0) AS same_type_substr,
                count_if(lslow = nslow) AS n_exact,
                count_if(lslow = nslow AND lcat = ncat) AS n_exact_same_cat,
                bool_or(ltype = ntype) AS same_type_overlap,
                bool_or(ltype = 'email' AND instr(llow, nlow) > 0) AS in_email
              FROM pairs GROUP BY doc_id, nseq),
    fl AS (SELECT g1.*, f.nseq IS NOT NULL AS has_overlap, coalesce(f.inside_place, false) AS inside_place,
                  coalesce(f.fragment, false) AS fragment, coalesce(f.same_type_substr, false) AS same_type_substr,
                  coalesce(f.n_exact, 0) AS n_exact, coalesce(f.n_exact_same_cat, 0) AS n_exact_same_cat,
                  coalesce(f.same_type_overlap, false) AS same_type_overlap, coalesce(f.in_email, false) AS in_email
           FROM g1 LEFT JOIN flags f ON g1.doc_id = f.doc_id AND g1.seq = f.nseq),
    surv AS (SELECT doc_id, seq, value, category, entity_type, confidence, 'merged' AS source FROM fl
             WHERE CASE WHEN entity_type IN {sem} THEN
                     has_overlap
                     AND NOT (entity_type = 'indirizzo' AND NOT regexp_matches({us('value')}, '[,0-9]') AND inside_place)
                     AND NOT fragment AND NOT same_type_substr AND NOT (n_exact > 0 AND n_exact_same_cat = 0)
                   ELSE NOT same_type_overlap AND NOT (entity_type = 'url' AND in_email) END),
    both_ AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, seq)::INTEGER AS seq,
                     value, category, entity_type, confidence, source
              FROM (SELECT *, 0 AS part FROM llm UNION ALL SELECT *, 1 AS part FROM surv)),
    births AS (SELECT DISTINCT doc_id, lower({us('value')}) AS k FROM both_
               WHERE category = 'persone_fisiche' AND entity_type = 'data_nascita'),
    merged AS (SELECT b.* FROM both_ b WHERE NOT (b.category = 'dati_temporali' AND EXISTS (
                 SELECT 1 FROM births x WHERE x.doc_id = b.doc_id AND x.k = lower({us('b.value')})))),
    legal0 AS (SELECT m.*, m.category = 'persone_fisiche'
                 AND regexp_matches(m.value, {S.q(M.CORPORATE_SUFFIX_RE.replace('(?iu)', '(?i)'))}) AS by_suffix
               FROM merged m),
    legal AS (SELECT m.*,
                CASE WHEN m.category = 'persone_fisiche' AND NOT m.by_suffix
                     THEN {_legal_hit_sql('d.content', 'm.value')} ELSE false END AS by_context
              FROM legal0 m JOIN dd d ON d.doc_id = m.doc_id),
    retyped AS (SELECT doc_id, seq, value,
                  CASE WHEN by_suffix OR by_context THEN 'persone_giuridiche' ELSE category END AS category,
                  CASE WHEN by_suffix OR by_context THEN 'nome_azienda' ELSE entity_type END AS entity_type,
                  confidence, source, by_suffix, by_context FROM legal),
    valid AS (SELECT * FROM retyped WHERE NOT (entity_type = 'codice_fiscale'
                AND NOT regexp_matches({us('value')}, {S.q(vocab.FISCAL_CODE_PATTERN.replace('(?i)', ''))}, 'i'))),
    known AS (SELECT doc_id, list(lower(value)) AS known, max(seq) AS max_seq FROM valid GROUP BY doc_id),
    cand AS (SELECT doc_id, list_transform(regexp_extract_all(content, {S.q(M.INSTITUTION_RE)}), lambda v: {us('v')}) AS found
             FROM dd),
    added AS (SELECT c.doc_id, coalesce(k.max_seq, 0) AS base,
                list_reduce(c.found, lambda acc, v: CASE WHEN len(list_filter(acc.seen, lambda s: instr(s, lower(v)) > 0)) > 0
                    THEN acc ELSE {{'seen': list_append(acc.seen, lower(v)), 'added': list_append(acc.added, v)}} END,
                  {{'seen': coalesce(k.known, []::VARCHAR[]), 'added': []::VARCHAR[]}}).added AS added
              FROM cand c LEFT JOIN known k ON k.doc_id = c.doc_id WHERE len(c.found) > 0),
    inst AS (SELECT doc_id, (base + i)::INTEGER AS seq, v AS value, 'persone_giuridiche' AS category,
                    'nome_organizzazione' AS entity_type, {vocab.INSTITUTION_CONFIDENCE}::DOUBLE AS confidence, 'ner' AS source
             FROM (SELECT doc_id, base, unnest(added) AS v, unnest(range(1, len(added) + 1)) AS i FROM added)),
    ident AS (SELECT doc_id, seq, value, category, entity_type, confidence, source FROM valid
              UNION ALL SELECT * FROM inst)"""


def _legal_hit_sql(text: str, value: str) -> str:
    """The rule as a pattern: phrase, up to 200 characters, value; or the other way round."""
    phrases = "(" + "|".join(re.escape(p.lower()) for p in vocab.LEGAL_CONTEXT_PHRASES) + ")"
    win = vocab.LEGAL_CONTEXT_WINDOW
    v = f"regexp_escape(lower({value}))"
    return (f"(length({value}) > 0 AND regexp_matches(lower({text}), {S.q(phrases)} || '.{{0,{win}}}' || {v} || '|' || {v} "
            f"|| '.{{0,{win}}}' || {S.q(phrases)}, 's'))")


def false_positive_filter() -> str:
    hits = S.recognizer_array("content", R.SEMANTIC)
    v = S.clean_span("h.value")
    return (f"WITH dd AS ({DV.docs_sql()}), x AS (SELECT doc_id, language, unnest({hits}) AS h FROM dd) "
            f"SELECT doc_id, h.rank AS rank, h.occ AS occ, {v} AS value, h.detector_type AS detector_type, "
            f"{S.semantic_fp(v, 'h.detector_type', 'language')} AS is_false_positive FROM x")


def _merge_q(select: str) -> str:
    return _merge_ctes() + " " + select


def merge_oracles() -> dict:
    sem = "(" + ", ".join(S.q(t) for t in vocab.SEMANTIC_MERGE_TYPES) + ")"
    return {
        "false_positive_filter": false_positive_filter(),
        "overlap_join": _merge_q("SELECT doc_id, nseq, lseq FROM pairs"),
        "merge_semantic": _merge_q(f"SELECT doc_id, seq, value, entity_type FROM surv WHERE entity_type IN {sem}"),
        "merge_structural": _merge_q(f"SELECT doc_id, seq, value, entity_type FROM surv WHERE entity_type NOT IN {sem}"),
        "url_in_email": _merge_q("SELECT doc_id, seq, value FROM fl WHERE has_overlap AND entity_type = 'url' "
                                 "AND in_email AND NOT same_type_overlap"),
        "date_dedup": _merge_q("SELECT doc_id, seq, value, category, entity_type, source FROM merged"),
        "legal_suffix": _merge_q("SELECT doc_id, seq, value FROM legal WHERE by_suffix"),
        "legal_context": _merge_q("SELECT doc_id, seq, value FROM legal WHERE by_context"),
        "fiscal_code_validate": _merge_q("SELECT doc_id, seq, value, entity_type FROM retyped r WHERE NOT EXISTS "
                                         "(SELECT 1 FROM valid v WHERE v.doc_id = r.doc_id AND v.seq = r.seq)"),
        "institutions": _merge_q("SELECT doc_id, seq, value FROM inst"),
        "identify": _merge_q("SELECT doc_id, seq, value, category, entity_type, source FROM ident"),
    }


def classify_oracles() -> dict:
    from ..operators import classify as C
    head = f"substr(content, 1, {vocab.DOC_TYPE_HEAD_CHARS})"
    case = " ".join(f"WHEN regexp_matches({head}, {S.q('(?i)' + p)}) THEN {S.q(k)}" for k, p in vocab.DOC_TYPE_PATTERNS)
    toks = f"string_split_regex(lower(content), {S.q(C.TOKEN_SPLIT)})"
    scores = ", ".join(
        f"{{'neg': -len(list_filter({toks}, lambda t: list_contains([{', '.join(S.q(w) for w in words)}], t))), 'lang': {S.q(lang)}}}"
        for lang, words in sorted(C.STOPWORDS.items()))
    best = f"list_sort([{scores}])[1]"
    return {
        "doc_type": f"WITH dd AS ({DV.docs_sql()}) SELECT doc_id, CASE {case} ELSE NULL END AS doc_type FROM dd",
        "language_detect": (f"SELECT doc_id, language, CASE WHEN b.neg < 0 THEN b.lang ELSE {S.q(vocab.DEFAULT_LANGUAGE)} END "
                            f"AS detected_language FROM (SELECT doc_id, lang AS language, text AS content, {best.replace('content', 'text')} AS b FROM documents)"),
    }


# ------------------------------------------------------------ roles (SQL)

def _remap_sql(role: str) -> str:
    body = " ".join(f"WHEN doc_type = {S.q(d)} AND {role} = {S.q(r)} THEN {S.q(t)}" for d, r, t in vocab.ROLE_CONSTRAINTS)
    cats = "(" + ", ".join(S.q(c) for c in vocab.ROLE_CATEGORIES) + ")"
    return f"(CASE WHEN category IN {cats} AND {role} IS NOT NULL THEN (CASE {body} ELSE {role} END) ELSE {role} END)"


def _role_ctes(docs: str | None = None, model: str | None = None, override: str | None = None, recognizers=None) -> str:
    head = f"substr(content, 1, {vocab.DOC_TYPE_HEAD_CHARS})"
    case = " ".join(f"WHEN regexp_matches({head}, {S.q('(?i)' + p)}) THEN {S.q(k)}" for k, p in vocab.DOC_TYPE_PATTERNS)
    ptypes = "(" + ", ".join(S.q(t) for t in vocab.PERSON_ROLE_TYPES) + ")"
    otypes = "(" + ", ".join(S.q(t) for t in vocab.ORG_ROLE_TYPES) + ")"
    donors = "(" + ", ".join(S.q(t) for t in vocab.PROXIMITY_DONOR_TYPES) + ")"
    asg_t = "STRUCT(value VARCHAR, role VARCHAR)"
    own_t = "STRUCT(value VARCHAR, owner_role VARCHAR)"
    e = chr(39) * 2
    def vm(stage, field, st, rf):
        return (f"SELECT doc_id, value, max_by(role, pos) AS role FROM (SELECT doc_id, pos, "
                f"{S.ustrip(f'coalesce(it.value, {e})')} AS value, {S.role_normal_form(f'coalesce(it.{rf}, {e})')} AS role "
                f"FROM {S.parsed_items('mo', stage, field, st)}) WHERE length(value) > 0 AND length(role) > 0 GROUP BY doc_id, value")
    nv = "rtrim(lower(" + S.ustrip("value") + "), '.')"
    detected = f"CASE {case} ELSE NULL END"
    if override:
        types = "(" + ", ".join(S.q(t) for t in vocab.DOC_TYPES) + ")"
        detected = f"CASE WHEN {override} IN {types} THEN {override} ELSE {detected} END"
    return _merge_ctes(docs, model, recognizers) + f""",
    dt AS (SELECT doc_id, {detected} AS doc_type FROM dd),
    asg AS ({vm('roles', 'assignments', asg_t, 'role')}),
    own AS ({vm('ownership', 'ownership', own_t, 'owner_role')}),
    e0 AS (SELECT i.*, dt.doc_type,
             (i.category = 'persone_fisiche' AND i.entity_type IN {ptypes}) OR
             (i.category = 'persone_giuridiche' AND i.entity_type IN {otypes}) AS actor
           FROM ident i LEFT JOIN dt ON dt.doc_id = i.doc_id),
    p1 AS (SELECT e0.*, CASE WHEN e0.actor THEN a.role END AS r1
           FROM e0 LEFT JOIN asg a ON a.doc_id = e0.doc_id AND a.value = e0.value AND e0.actor),
    p15 AS (SELECT *, {_remap_sql('r1')} AS r15 FROM p1),
    ar AS (SELECT doc_id, list(DISTINCT r15) FILTER (WHERE r15 IS NOT NULL) AS valid,
                  list(DISTINCT r15) FILTER (WHERE r15 IS NOT NULL AND category = 'persone_fisiche') AS person_roles
           FROM p15 WHERE actor GROUP BY doc_id),
    p2 AS (SELECT p.*, CASE WHEN NOT p.actor AND p.r15 IS NULL AND o.role IS NOT NULL AND len(coalesce(ar.valid, [])) > 0
                 THEN (CASE WHEN NOT list_contains(list_concat(ar.valid, ['documento']), o.role)
                                 AND len(coalesce(ar.person_roles, [])) = 1 THEN ar.person_roles[1] ELSE o.role END)
                 ELSE p.r15 END AS r2
           FROM p15 p LEFT JOIN ar ON ar.doc_id = p.doc_id
           LEFT JOIN own o ON o.doc_id = p.doc_id AND o.value = p.value AND NOT p.actor AND p.r15 IS NULL),
    pa AS (SELECT n.doc_id, n.seq, min_by(d.r2, d.seq) AS prop
           FROM (SELECT *, {nv} AS nv FROM p2 WHERE r2 IS NULL) n
           JOIN (SELECT *, {nv} AS nv FROM p2 WHERE r2 IS NOT NULL) d
             ON d.doc_id = n.doc_id AND d.entity_type = n.entity_type AND (instr(d.nv, n.nv) > 0 OR instr(n.nv, d.nv) > 0)
           GROUP BY n.doc_id, n.seq),
    p3a AS (SELECT p2.*, coalesce(p2.r2, pa.prop) AS r3a FROM p2 LEFT JOIN pa ON pa.doc_id = p2.doc_id AND pa.seq = p2.seq),
    pos AS (SELECT p.doc_id, p.seq, instr(d.content, p.value) - 1 AS pos FROM p3a p JOIN dd d ON d.doc_id = p.doc_id),
    p3p AS (SELECT p3a.*, pos.pos FROM p3a LEFT JOIN pos ON pos.doc_id = p3a.doc_id AND pos.seq = p3a.seq),
    pb AS (SELECT doc_id, seq, role FROM (
             SELECT n.doc_id, n.seq, d.r3a AS role, row_number() OVER (PARTITION BY n.doc_id, n.seq
                    ORDER BY abs(d.pos - n.pos), d.seq) AS rn
             FROM p3p n JOIN p3p d ON d.doc_id = n.doc_id AND abs(d.pos - n.pos) <= {vocab.PROXIMITY_THRESHOLD}
             WHERE n.r3a IS NULL AND n.pos >= 0 AND d.r3a IS NOT NULL AND d.entity_type IN {donors} AND d.pos >= 0)
           WHERE rn = 1),
    p3b AS (SELECT p3p.*, coalesce(p3p.r3a, pb.role) AS r3b FROM p3p LEFT JOIN pb ON pb.doc_id = p3p.doc_id AND pb.seq = p3p.seq),
    fin AS (SELECT *, CASE WHEN bool_or(actor) OVER (PARTITION BY doc_id) THEN {_remap_sql('r3b')} END AS semantic_role FROM p3b)"""


def role_oracles() -> dict:
    c = _role_ctes()
    return {
        "assign_roles": c + " SELECT doc_id, seq, value, r15 AS role_lookup FROM p15 WHERE actor",
        "role_remap": c + " SELECT p.doc_id, p.seq, p.doc_type, a.role AS before, p.r15 AS after FROM p15 p "
                          "JOIN asg a ON a.doc_id = p.doc_id AND a.value = p.value AND p.actor WHERE a.role <> p.r15",
        "ownership": c + " SELECT doc_id, seq, value, r2 AS owner FROM p2 WHERE NOT actor AND r2 IS NOT NULL",
        "propagate_same_type": c + " SELECT doc_id, seq, value, r3a AS role FROM p3a WHERE r2 IS NULL AND r3a IS NOT NULL",
        "propagate_proximity": c + " SELECT doc_id, seq, value, r3b AS role FROM p3b WHERE r3a IS NULL AND r3b IS NOT NULL",
        "roles_final": c + " SELECT doc_id, seq, value, category, entity_type, semantic_role, doc_type FROM fin",
    }


# ------------------------------------------------------------ labels and substitution (SQL)

def label_oracles() -> dict:
    c = _role_ctes()
    lab = S.label_for("f.category", "f.entity_type", "f.semantic_role")
    pk = (", pk AS (SELECT doc_id, list({'seq': seq, 'value': value, 'category': category, "
          "'entity_type': entity_type, 'semantic_role': semantic_role} ORDER BY seq) AS ents FROM fin GROUP BY doc_id)")
    lang = "d.language"
    dedup = S.greedy_dedup("pk.ents", ENT_T)
    return {
        "label_choice": c + f" SELECT f.doc_id, f.seq, {lab} AS label FROM fin f",
        "label_localise": c + f" SELECT f.doc_id, f.seq, {S.localise(lab, 'd.language')} AS label "
                              "FROM fin f JOIN dd d ON d.doc_id = f.doc_id",
        "greedy_dedup": c + pk + f" SELECT doc_id, e.seq AS seq, e.value AS value, e.entity_type AS entity_type "
                                 f"FROM (SELECT doc_id, unnest({dedup}) AS e FROM pk)",
        "number_placeholders": c + pk + f" SELECT doc_id, m.ord AS ord, m.original AS original, m.replacement AS replacement "
                                        f"FROM (SELECT pk.doc_id, unnest({S.number_placeholders(dedup, lang)}) AS m "
                                        f"FROM pk JOIN dd d ON d.doc_id = pk.doc_id)",
        "preview_numbers": c + pk + f" SELECT doc_id, m.ord AS ord, m.original AS original, m.replacement AS proposed_replacement "
                                    f"FROM (SELECT pk.doc_id, unnest({S.number_placeholders('pk.ents', lang)}) AS m "
                                    f"FROM pk JOIN dd d ON d.doc_id = pk.doc_id)",
        "redact_derived": c + pk + f", mm AS (SELECT d.doc_id, d.content, "
                                   f"{S.number_placeholders(S.greedy_dedup(f'coalesce(pk.ents, []::{ENT_T}[])', ENT_T), lang)} AS mappings "
                                   f"FROM dd d LEFT JOIN pk ON pk.doc_id = d.doc_id) "
                                   f"SELECT doc_id, len(mappings)::BIGINT AS n_mappings, {S.substitute('content', 'mappings')} AS anonymized FROM mm",
        "redact_conversations": _redact_conversations(),
    }


def _redact_conversations() -> str:
    det = S.detected_array("text", "NULL::VARCHAR", None, R.unconfirmed_safe())
    return f"""WITH t AS (SELECT conv_id, turn, {det} AS detected FROM conversations),
    e AS (SELECT conv_id, turn, x.seq AS tseq, x.value AS value, x.category AS category, x.entity_type AS entity_type
          FROM (SELECT conv_id, turn, unnest(detected) AS x FROM t)),
    n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, tseq)::INTEGER AS seq,
                 value, category, entity_type FROM e),
    pk AS (SELECT conv_id, list({{'seq': seq, 'value': value, 'category': category, 'entity_type': entity_type,
                                 'semantic_role': NULL::VARCHAR}} ORDER BY seq) AS ents FROM n GROUP BY conv_id),
    mp AS (SELECT conv_id, {S.number_placeholders(S.greedy_dedup('ents', ENT_T), "'it'")} AS mappings FROM pk)
    SELECT c.conv_id, c.turn, c.role,
           CASE WHEN mp.mappings IS NULL THEN c.text ELSE {S.substitute('c.text', 'mp.mappings')} END AS anonymized
    FROM conversations c LEFT JOIN mp ON mp.conv_id = c.conv_id"""


# ------------------------------------------------------------ evaluation (SQL)

def _norm_sql(v: str) -> str:
    chars = vocab.EVAL_TRIM_CHARS
    cls = "".join("\\" + ch if ch in "\\^-[]" else ch for ch in chars)
    stripped = f"regexp_replace({v}, {S.q(f'^[{cls}]+|[{cls}]+$')}, '', 'g')"
    return f"regexp_replace(lower({stripped}), '\\s+', ' ', 'g')"


def _eval_ctes() -> str:
    return _merge_ctes() + f""",
    gt AS (SELECT doc_id, value, category FROM ({DV.truth_sql()})),
    pr AS (SELECT i.doc_id, i.value, i.category FROM ident i WHERE i.doc_id IN (SELECT doc_id FROM gt)),
    ps AS (SELECT DISTINCT doc_id, {_norm_sql('value')} AS v, category FROM pr),
    ts AS (SELECT DISTINCT doc_id, {_norm_sql('value')} AS v, category FROM gt),
    strict AS (SELECT coalesce(ps.doc_id, ts.doc_id) AS doc_id, coalesce(ps.category, ts.category) AS category,
                      count_if(ps.v IS NOT NULL AND ts.v IS NOT NULL) AS tp,
                      count_if(ps.v IS NOT NULL AND ts.v IS NULL) AS fp,
                      count_if(ps.v IS NULL AND ts.v IS NOT NULL) AS fn
               FROM ps FULL OUTER JOIN ts ON ps.doc_id = ts.doc_id AND ps.v = ts.v AND ps.category = ts.category
               GROUP BY 1, 2),
    tv AS (SELECT DISTINCT doc_id, v FROM ts), pv AS (SELECT DISTINCT doc_id, v FROM ps),
    lp AS (SELECT ps.doc_id, ps.category, count_if(tv.v IS NOT NULL) AS tp, count_if(tv.v IS NULL) AS fp
           FROM ps LEFT JOIN tv ON tv.doc_id = ps.doc_id AND tv.v = ps.v GROUP BY 1, 2),
    lt AS (SELECT ts.doc_id, ts.category, count(*) AS fn FROM ts
           WHERE NOT EXISTS (SELECT 1 FROM pv WHERE pv.doc_id = ts.doc_id AND pv.v = ts.v) GROUP BY 1, 2),
    lenient AS (SELECT coalesce(lp.doc_id, lt.doc_id) AS doc_id, coalesce(lp.category, lt.category) AS category,
                       coalesce(lp.tp, 0) AS tp, coalesce(lp.fp, 0) AS fp, coalesce(lt.fn, 0) AS fn
                FROM lp FULL OUTER JOIN lt ON lp.doc_id = lt.doc_id AND lp.category = lt.category)"""


def eval_oracles() -> dict:
    c = _eval_ctes()
    cats = ", ".join(f"({S.q(x)})" for x in vocab.CATEGORIES)
    stem = "regexp_replace(d.filename, '\\.[^./]*$', '')"
    lang = "CASE " + " ".join(
        f"WHEN ends_with({stem}, {S.q('_' + l)}) THEN {S.q('DE' if l == 'DECH' else l)}"
        for l in vocab.EVAL_LANG_SUFFIXES) + " ELSE '??' END"
    def prf(tp, fp, fn):
        p = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END)"
        r = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END)"
        f = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
        return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1"
    report = c + f""",
    dl AS (SELECT d.doc_id, {lang} AS lang FROM dd d),
    docs_ AS (SELECT DISTINCT s.doc_id, dl.lang FROM strict s LEFT JOIN dl ON dl.doc_id = s.doc_id),
    full_ AS (SELECT g.doc_id, g.lang, k.category, coalesce(s.tp, 0) AS tp, coalesce(s.fp, 0) AS fp, coalesce(s.fn, 0) AS fn
              FROM docs_ g, (VALUES {cats}) k(category)
              LEFT JOIN strict s ON s.doc_id = g.doc_id AND s.category = k.category),
    agg AS (SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(lang) = 0 THEN 'language'
                        WHEN grouping(doc_id) = 0 THEN 'document' ELSE 'total' END AS grouping,
                   coalesce(category, lang, cast(doc_id AS VARCHAR), 'all') AS grp,
                   sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn
            FROM full_ GROUP BY GROUPING SETS ((category), (lang), (doc_id), ()))
    SELECT grouping, grp, tp, fp, fn, {prf('tp::DOUBLE', 'fp', 'fn')} FROM agg"""
    summary = c + f""",
    st AS (SELECT count(*) AS total_documents,
                  count_if(CASE WHEN json_valid({S.json_payload('raw')})
                           THEN try_cast(json_extract({S.json_payload('raw')}, '$.entities') AS {ITEM_T}[]) IS NOT NULL
                           ELSE false END) AS success
           FROM mo WHERE stage = 'entities')
    SELECT 'status' AS kind, 'total_documents' AS key, total_documents::BIGINT AS n FROM st
    UNION ALL SELECT 'status', 'success', success::BIGINT FROM st
    UNION ALL SELECT 'status', 'errors', (total_documents - success)::BIGINT FROM st
    UNION ALL SELECT 'source', source, count(*)::BIGINT FROM ident GROUP BY source
    UNION ALL SELECT 'category', k.category, count(i.category)::BIGINT FROM (VALUES {cats}) k(category)
              LEFT JOIN ident i ON i.category = k.category GROUP BY k.category"""
    return {
        "eval_strict": c + " SELECT doc_id, category, tp, fp, fn FROM strict",
        "eval_lenient": c + " SELECT doc_id, category, tp, fp, fn FROM lenient",
        "eval_grouping_sets": report,
        "run_summary": summary,
    }


# ------------------------------------------------------------ ingest, review, audit, retention (SQL)

def _references_sql(html: str) -> str:
    from ..operators import governance as G
    names = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in G.NAMED_REFERENCES.items()) + "}"
    body = "substr(x.r, 2, length(x.r) - 2)"
    code = (f"CASE WHEN starts_with(lower({body}), '#x') THEN ('0x' || substr({body}, 3))::INTEGER WHEN starts_with({body}, '#') "
            f"THEN substr({body}, 2)::INTEGER ELSE {names}[{body}] END")
    char = (f"list_transform([{code}], lambda c: CASE WHEN c = 160 THEN ' ' WHEN c > 0 AND c < 1114112 AND NOT c BETWEEN 55296 AND 57343 "
            f"THEN chr(c) ELSE x.r END)[1]")
    return (f"list_transform([{html}], lambda h: CASE WHEN contains(h, '&') THEN array_to_string(list_transform(list_zip("
            f"regexp_split_to_array(h, {S.q(G.REFERENCE_RE)}), regexp_extract_all(h, {S.q(G.REFERENCE_RE)})), "
            f"lambda z: z[1] || coalesce(list_transform([{{'r': z[2]}}], lambda x: CASE WHEN x.r IS NULL THEN NULL ELSE {char} END)[1], '')), '') ELSE h END)[1]")


def governance_oracles() -> dict:
    from ..operators import governance as G
    from . import catalog as CAT
    html = "html"
    for pat, rep in G.HTML_RULES:
        html = f"regexp_replace({html}, {S.q(pat)}, {S.q(rep.replace(chr(92), chr(92) * 2))}, 'g')"
    html = _references_sql(html)
    for pat, rep in G.SPACE_RULES:
        html = f"regexp_replace({html}, {S.q(pat)}, {S.q(rep)}, 'g')"
    txt = f"regexp_replace({html}, '^\\s+|\\s+$', '', 'g')"
    supported = vocab.PLAIN_TEXT_EXTENSIONS + vocab.CONVERTER_EXTENSIONS
    sup = "(" + ", ".join(S.q(x) for x in supported) + ")"
    listing = ", ".join(sorted(supported))
    ext = "lower(regexp_extract(filename, '(\\.[^./]+)$', 1))"
    entries = ("WITH ev AS (SELECT user_id AS doc_id, ts, props FROM events), "
               "en AS (SELECT doc_id, min(ts) AS created_at, max(ts) AS last_accessed, "
               "(sum(length(props)) * 1024)::BIGINT AS size_bytes FROM ev GROUP BY doc_id)")
    decisions = ("SELECT user_id AS doc_id, ((event_id % 20) + 1)::INTEGER AS seq, "
                 "CASE WHEN event_type IN ('click', 'purchase') THEN 'accepted' WHEN event_type = 'error' THEN 'removed' "
                 "WHEN event_type = 'signup' THEN 'proposed' END AS status, ts AS decided_at, event_id FROM events")
    review = _merge_ctes() + f""",
    dec AS (SELECT * FROM ({decisions}) WHERE status IS NOT NULL),
    lat AS (SELECT doc_id, seq, arg_max(status, {{'t': decided_at, 'e': event_id}}) AS status FROM dec GROUP BY doc_id, seq),
    st AS (SELECT i.*, coalesce(l.status, 'proposed') AS status FROM ident i
           LEFT JOIN lat l ON l.doc_id = i.doc_id AND l.seq = i.seq)"""
    pk = ("pk AS (SELECT doc_id, list({'seq': seq, 'value': value, 'category': category, 'entity_type': entity_type, "
          "'semantic_role': NULL::VARCHAR} ORDER BY seq) AS ents FROM st WHERE status = 'accepted' GROUP BY doc_id)")
    lang = "coalesce(nullif(d.language, ''), 'it')"
    fp = ("SELECT doc_id, length(text)::BIGINT AS char_count, strlen(text)::BIGINT AS size_bytes, "
          "sha256(text) AS sha256 FROM documents")
    return {
        "html_to_text": f"SELECT page_id, {txt} AS text, length({txt})::BIGINT AS char_count FROM pages",
        "format_gate": (f"WITH dd AS ({DV.docs_sql()}), files AS ("
                        "SELECT 'documents' AS source, doc_id AS id, filename FROM dd UNION ALL "
                        "SELECT 'pages', page_id, regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) FROM pages) "
                        f"SELECT source, id, filename, {ext} AS ext, {ext} IN {sup} AS supported, "
                        f"CASE WHEN NOT ({ext} IN {sup}) THEN 'cannot read files of type ' || {ext} || '; readable types are {listing}' END AS reason "
                        "FROM files"),
        "fingerprint": fp,
        "audit_events": review + f""",
    counts AS (SELECT d.doc_id, d.filename, d.content, count(st.seq) AS found, count_if(st.status = 'accepted') AS active
               FROM dd d LEFT JOIN st ON st.doc_id = d.doc_id GROUP BY ALL),
    base AS (SELECT *, {S.q(CAT.RUN_TS)} AS ts, cast(doc_id AS VARCHAR) AS id FROM counts)
    SELECT doc_id, 'document_uploaded' AS event, to_json({{'timestamp': ts, 'event': 'document_uploaded', 'document_id': id, 'file_hash': sha256(content),
           'filename': filename, 'file_size_bytes': strlen(content)}})::VARCHAR AS line FROM base
    UNION ALL SELECT doc_id, 'entities_extracted', to_json({{'timestamp': ts, 'event': 'entities_extracted', 'document_id': id, 'entity_count': found}})::VARCHAR FROM base
    UNION ALL SELECT doc_id, 'document_anonymized', to_json({{'timestamp': ts, 'event': 'document_anonymized', 'document_id': id, 'entity_count': active}})::VARCHAR FROM base""",
        "ttl_expire": ("WITH en AS (SELECT event_id AS doc_id, ts AS created_at, ts AS last_accessed FROM events)"
                       f" SELECT doc_id, created_at, last_accessed FROM en "
                       f"WHERE epoch_us(TIMESTAMP '{CAT.NOW}') - epoch_us(created_at) <= {vocab.CACHE_TTL_SECONDS * 1000000}::BIGINT"),
        "lru_evict": (entries + ", r AS (SELECT doc_id, last_accessed, size_bytes, sum(size_bytes) OVER ("
                      "ORDER BY last_accessed DESC, created_at DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running FROM en) "
                      f"SELECT * FROM r WHERE running <= {CAT.LRU_BUDGET}"),
        "review_progress": review + """
    SELECT doc_id, count(*) AS total, count_if(status = 'accepted') AS accepted, count_if(status = 'removed') AS removed,
           count_if(status = 'proposed') AS proposed, count(*) - count_if(status = 'removed') AS active,
           round(CASE WHEN count(*) > 0 THEN (count_if(status = 'accepted') + count_if(status = 'removed')) * 100.0 / count(*) ELSE 0.0 END, 2) AS validated_pct,
           count_if(status = 'proposed') = 0 AS gate_open
    FROM st GROUP BY doc_id""",
        "review_apply": review + f""", {pk},
    mm AS (SELECT d.doc_id, d.content, {S.number_placeholders(S.greedy_dedup('pk.ents', ENT_T), lang)} AS mappings
           FROM dd d JOIN pk ON pk.doc_id = d.doc_id)
    SELECT doc_id, len(mappings)::BIGINT AS n_mappings, {S.substitute('content', 'mappings')} AS anonymized FROM mm""",
    }


def prompt_oracles() -> dict:
    from ..operators import model as MD
    head = MD.ENTITY_HEAD + "\n".join(f"  - {c}" for c in vocab.CATEGORIES) + MD.ENTITY_TEXT
    ptypes = "(" + ", ".join(S.q(t) for t in vocab.PERSON_ROLE_TYPES) + ")"
    otypes = "(" + ", ".join(S.q(t) for t in vocab.ORG_ROLE_TYPES) + ")"
    return {
        "entity_prompts": f"WITH dd AS ({DV.docs_sql()}) SELECT doc_id, {S.q(head)} || content AS prompt FROM dd",
        "role_prompts": _merge_ctes() + f""",
    act AS (SELECT doc_id, list('  - "' || value || '" (' || category || ')' ORDER BY seq) AS lines FROM ident
            WHERE (category = 'persone_fisiche' AND entity_type IN {ptypes})
               OR (category = 'persone_giuridiche' AND entity_type IN {otypes}) GROUP BY doc_id)
    SELECT a.doc_id, {S.q(MD.ROLE_HEAD)} || array_to_string(a.lines, chr(10)) || {S.q(MD.ROLE_TEXT)}
           || substr(d.content, 1, {vocab.ROLE_PROMPT_HEAD_CHARS}) AS prompt
    FROM act a JOIN dd d ON d.doc_id = a.doc_id""",
    }


# ------------------------------------------------------------ extract runs (SQL)

def _language_sql(content: str) -> str:
    from ..operators import classify as C
    toks = f"string_split_regex(lower({content}), {S.q(C.TOKEN_SPLIT)})"
    hits = [f"{{'neg': -len(list_filter({toks}, lambda t: list_contains([{', '.join(S.q(w) for w in words)}], t))), 'lang': {S.q(lang)}}}"
            for lang, words in sorted(C.STOPWORDS.items())]
    return f"list_transform([list_sort([{', '.join(hits)}])[1]], lambda b: CASE WHEN b.neg < 0 THEN b.lang ELSE {S.q(vocab.DEFAULT_LANGUAGE)} END)[1]"


def _placeholder_ctes(language: str = "d.language") -> str:
    """fin with the proposed placeholder: numbered longest-first per localised label."""
    lab = S.localise(S.label_for("f.category", "f.entity_type", "f.semantic_role"), language)
    return f""",
    lb AS (SELECT f.*, {lab} AS label FROM fin f JOIN dd d ON d.doc_id = f.doc_id),
    pr_ AS (SELECT *, '[' || label || '_' || cast(row_number() OVER (PARTITION BY doc_id, label ORDER BY length(value) DESC, seq) AS VARCHAR) || ']' AS shown FROM lb)"""


def _real_model() -> tuple[str, str]:
    """The real documents with their detected language, and what the stand-in model answers."""
    from . import catalog as CAT
    from ..operators import model as MD
    docs = f"SELECT doc_id, text AS content, {_language_sql('text')} AS language FROM documents"
    head = len(MD.ENTITY_HEAD + "\n".join(f"  - {c}" for c in vocab.CATEGORIES) + MD.ENTITY_TEXT)
    item = """'{"value": "' || v || '", "category": "dati_contatto", "entity_type": "indirizzo_email"}'"""
    raw = f"""'{{"entities": [' || array_to_string(list_transform(regexp_extract_all(text, {S.q(R.STRUCTURAL[0].pattern)}), lambda v: {item}), ', ') || ']}}'"""
    model = f"SELECT doc_id, 'entities' AS stage, CASE WHEN length(text) + {head} <= {CAT.PROMPT_LIMIT} THEN {raw} END AS raw FROM documents"
    return docs, model


def _extract_select() -> str:
    fields = ["value", "category", "entity_type", "confidence", "source", "semantic_role"]
    item = "{" + ", ".join(f"'{c}': {c}" for c in fields) + ", 'proposed_replacement': shown}"
    return f"""
    ej AS (SELECT doc_id, list({item} ORDER BY seq) AS ents FROM pr_ GROUP BY doc_id),
    failed AS (SELECT doc_id, raw IS NULL AS failed FROM mo WHERE stage = 'entities'),
    ex AS (SELECT d.doc_id, CASE WHEN f.failed THEN 'error' ELSE 'success' END AS status, CASE WHEN f.failed THEN 'ValueError' END AS error, d.language,
                  dt.doc_type AS document_type, CASE WHEN NOT f.failed THEN coalesce(len(ej.ents), 0) END AS entities_count,
                  CASE WHEN NOT f.failed THEN coalesce(to_json(ej.ents)::VARCHAR, '[]') END AS entities, d.content
           FROM dd d JOIN dt USING (doc_id) JOIN failed f USING (doc_id) LEFT JOIN ej USING (doc_id))"""


def extract_oracles() -> dict:
    from . import catalog as CAT
    from ..operators import model as MD
    derived = f"SELECT * REPLACE ({_language_sql('content')} AS language) FROM ({DV.docs_sql()})"
    docs, model = _real_model()
    digest = " SELECT doc_id, status, error, language, document_type, entities_count::BIGINT AS entities_count, entities FROM ex"
    real = _role_ctes(docs, model, recognizers=R.STRUCTURAL) + _placeholder_ctes() + "," + _extract_select()
    pk = (", pk AS (SELECT doc_id, list({'seq': seq, 'value': value, 'category': category, "
          "'entity_type': entity_type, 'semantic_role': semantic_role} ORDER BY seq) AS ents FROM fin GROUP BY doc_id)")
    maps = S.number_placeholders(S.greedy_dedup(f"coalesce(pk.ents, []::{ENT_T}[])", ENT_T), "ex.language")
    return {
        "extract_pipeline": _role_ctes(derived) + _placeholder_ctes() + "," + _extract_select() + digest,
        "extract_documents": real + digest,
        "model_hook": _merge_ctes(docs, model) + " SELECT m.doc_id, count(llm.doc_id)::BIGINT AS n_entities, CASE WHEN any_value(m.raw) IS NULL THEN 'ValueError' END AS error "
                                                  "FROM mo m LEFT JOIN llm ON llm.doc_id = m.doc_id GROUP BY m.doc_id",
        "run_records": real + pk + f""",
    mm AS (SELECT ex.*, CASE WHEN error IS NULL THEN {maps} END AS mappings FROM ex LEFT JOIN pk USING (doc_id))
    SELECT {S.q(CAT.RUN_ID)} AS run_id, 'doc_' || cast(doc_id AS VARCHAR) || '.txt' AS document, cast(doc_id AS VARCHAR) AS document_id,
           length(content)::BIGINT AS char_count, status, error, entities_count::BIGINT AS entities_count, len(mappings)::BIGINT AS mappings_count,
           CASE WHEN error IS NULL THEN substr({S.substitute('content', 'mappings')}, 1, {vocab.PREVIEW_CHARS}) END AS preview FROM mm""",
        "redact_isolated": _role_ctes() + pk.replace("pk AS", "pk AS") + f""",
    mm AS (SELECT d.doc_id, d.content, {S.number_placeholders(S.greedy_dedup(f"coalesce(pk.ents, []::{ENT_T}[])", ENT_T), 'd.language')} AS mappings
           FROM dd d LEFT JOIN pk ON pk.doc_id = d.doc_id),
    pt AS (SELECT *, array_to_string(list_transform(mappings, lambda m: regexp_escape(m.original)), '|') AS pat FROM mm),
    cut AS (SELECT *, regexp_split_to_array(content, pat) AS gaps, regexp_extract_all(content, pat) AS hits FROM pt WHERE pat <> '')
    SELECT doc_id, len(mappings)::BIGINT AS n_mappings, array_to_string(list_transform(list_zip(gaps, hits), lambda z: z[1] || coalesce(
           list_filter(mappings, lambda m: m.original = z[2])[1].replacement, '')), '') AS anonymized FROM cut
    UNION ALL SELECT doc_id, 0, content FROM pt WHERE pat = ''""",
        "type_override_rerun": _role_ctes(override="(CASE doc_id % 7 WHEN 0 THEN 'legal' WHEN 1 THEN 'contract' WHEN 2 THEN 'sconosciuto' END)") +
            f", was AS ({classify_oracles()['doc_type']})"
            " SELECT f.doc_id, f.seq, f.value, f.semantic_role, f.doc_type FROM fin f JOIN was w USING (doc_id) WHERE f.doc_type IS DISTINCT FROM w.doc_type",
        "ownership_prompts": _role_ctes() + f""",
    lines AS (SELECT doc_id, list('  - "' || value || '" is ' || r15 ORDER BY seq) FILTER (actor AND r15 IS NOT NULL) AS roles,
                     list('  - "' || value || '" (' || entity_type || ')' ORDER BY seq) FILTER (NOT actor AND r15 IS NULL) AS data FROM p15 GROUP BY doc_id)
    SELECT l.doc_id, {S.q(MD.OWNER_HEAD)} || array_to_string(roles, chr(10)) || {S.q(MD.OWNER_DATA)} || array_to_string(data, chr(10)) || {S.q(MD.ROLE_TEXT)}
           || substr(d.content, 1, {vocab.OWNERSHIP_PROMPT_HEAD_CHARS}) AS prompt FROM lines l JOIN dd d USING (doc_id) WHERE len(roles) > 0 AND len(data) > 0""",
        "entity_counts": _merge_ctes() + f""",
    n AS (SELECT doc_id, count(*) AS n FROM ident GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n FROM ({DV.truth_sql()}) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_pred, coalesce(g.n, 0)::BIGINT AS n_gt FROM dd d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""",
        "eval_sorted_report": eval_oracles()["eval_grouping_sets"],
        "eval_skipped": f"""WITH dd AS ({DV.docs_sql()}), mo AS ({DV.model_sql()}), gt AS (SELECT DISTINCT doc_id FROM ({DV.truth_sql()}) WHERE category = 'dati_temporali'),
    ok AS (SELECT doc_id, CASE WHEN json_valid({S.json_payload('raw')}) THEN try_cast(json_extract({S.json_payload('raw')}, '$.entities') AS {ITEM_T}[]) IS NOT NULL
                  ELSE false END AS ok FROM mo WHERE stage = 'entities')
    SELECT d.doc_id, CASE WHEN gt.doc_id IS NULL THEN 'no annotation' ELSE 'run failed' END AS reason
    FROM dd d LEFT JOIN gt USING (doc_id) JOIN ok USING (doc_id) WHERE gt.doc_id IS NULL OR NOT ok.ok""",
    }


# ------------------------------------------------------------ review and lookup (SQL)

def review_oracles() -> dict:
    from . import catalog as CAT
    action = ("CASE WHEN event_id % 61 = 0 THEN 'remove_all' WHEN event_id % 37 = 0 THEN 'accept_all' WHEN event_type IN ('click', 'purchase') THEN 'accepted' "
              "WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'signup' THEN 'proposed' END")
    pk = ("pk AS (SELECT doc_id, list({'seq': seq, 'value': value, 'category': category, 'entity_type': entity_type, 'semantic_role': semantic_role} "
          "ORDER BY seq) FILTER (status = 'accepted') AS ents FROM st GROUP BY doc_id)")
    single = ("CASE WHEN event_type IN ('click', 'purchase') THEN 'accepted' WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'signup' THEN 'proposed' END")
    label = "upper(coalesce(nullif(entity_type, ''), nullif(category, ''), 'entita'))"
    return {
        # the decisions on an entity replayed one by one, in the order they were made
        "review_bulk": _merge_ctes() + f""",
    dec AS (SELECT user_id AS doc_id, ((event_id % 20) + 1)::INTEGER AS seq, {action} AS action, ts, event_id FROM events),
    hit AS (SELECT i.doc_id, i.seq, list(d.action ORDER BY d.ts, d.event_id) AS actions FROM ident i JOIN dec d ON d.doc_id = i.doc_id
            AND d.action IS NOT NULL AND (d.seq = i.seq OR d.action IN ('accept_all', 'remove_all')) GROUP BY ALL)
    SELECT i.doc_id, i.seq, list_reduce(coalesce(actions, []::VARCHAR[]), lambda s, a: CASE WHEN a = 'remove_all' THEN 'removed'
           WHEN a = 'accept_all' THEN (CASE WHEN s = 'removed' THEN s ELSE 'accepted' END) ELSE a END, 'proposed') AS status
    FROM ident i LEFT JOIN hit h ON h.doc_id = i.doc_id AND h.seq = i.seq""",
        "mapping_write_back": _role_ctes() + _placeholder_ctes() + f""",
    dec AS (SELECT user_id AS doc_id, ((event_id % 20) + 1)::INTEGER AS seq, {single} AS status, ts, event_id FROM events),
    lat AS (SELECT doc_id, seq, arg_max(status, {{'t': ts, 'e': event_id}}) AS status FROM dec WHERE status IS NOT NULL GROUP BY doc_id, seq),
    st AS (SELECT p.*, coalesce(l.status, 'proposed') AS status FROM pr_ p LEFT JOIN lat l ON l.doc_id = p.doc_id AND l.seq = p.seq), {pk},
    maps AS (SELECT pk.doc_id, unnest({S.number_placeholders(S.greedy_dedup(f'coalesce(pk.ents, []::{ENT_T}[])', ENT_T), 'd.language')}) AS m FROM pk JOIN dd d ON d.doc_id = pk.doc_id),
    last_ AS (SELECT doc_id, m.original AS original, arg_max(m.replacement, m.ord) AS replacement, arg_max(coalesce(m.semantic_role, ''), m.ord) AS role FROM maps GROUP BY ALL)
    SELECT st.doc_id, st.seq, st.value AS original, coalesce(l.replacement, st.shown) AS substitution, coalesce(nullif(l.role, ''), st.semantic_role) AS semantic_role
    FROM st LEFT JOIN last_ l ON l.doc_id = st.doc_id AND l.original = st.value""",
        "placeholder_default": _role_ctes() + _placeholder_ctes() + f"""
    SELECT doc_id, seq, CASE WHEN category <> 'dati_contatto' THEN shown ELSE '[' || {label} || '_' || cast(row_number() OVER (
           PARTITION BY doc_id, category <> 'dati_contatto', {label} ORDER BY seq) AS VARCHAR) || ']' END AS substitution FROM pr_""",
        "document_lookup": f"""WITH st AS (SELECT DISTINCT user_id AS doc_id, ts AS created_at FROM events WHERE event_type = 'signup'),
    rq AS (SELECT event_id AS request_id, user_id AS doc_id, ts AS asked_at FROM events WHERE event_type IN ('view', 'click')),
    j AS (SELECT rq.*, st.created_at AS v FROM rq ASOF LEFT JOIN st ON rq.doc_id = st.doc_id AND rq.asked_at >= st.created_at),
    k AS (SELECT *, v IS NOT NULL AND epoch_us(asked_at) - epoch_us(v) <= {CAT.LOOKUP_TTL * 1000000}::BIGINT AS live FROM j)
    SELECT request_id, doc_id, CASE WHEN live THEN v END AS created_at,
           CASE WHEN v IS NULL THEN 'document not found' WHEN NOT live THEN 'document expired' END AS reason FROM k""",
    }


# ------------------------------------------------------------ detector options (SQL)

def _detected_ids(recs) -> str:
    return (f"WITH det AS (SELECT doc_id, {S.detected_array('content', 'language', None, recs)} AS detected FROM ({DV.identifiers_sql()})), "
            "e AS (SELECT doc_id, e.* FROM (SELECT doc_id, unnest(detected) AS e FROM det))")


def option_oracles() -> dict:
    from . import catalog as CAT
    ids = _recs(*CAT.ID_TYPES)
    kinds = {t: e for t, _, e in vocab.DETECTOR_TYPE_MAP}
    base = " OR ".join(f"(entity_type = {S.q(k)} AND confidence NOT IN ({', '.join(str(r.score) for r in ids if kinds[r.detector_type] == k)}))"
                       for k in sorted({kinds[r.detector_type] for r in ids}))
    wanted = ["dati_contatto", "dati_finanziari"]
    words = "regexp_split_to_array(value, '\\s+')"
    return {
        "category_filter": (f"WITH {_docs_cte()}, det AS (SELECT doc_id, {S.detected_array('content', 'language', wanted)} AS detected FROM docs) "
                            "SELECT doc_id, e.seq AS seq, e.value AS value, e.category AS category, e.entity_type AS entity_type FROM (SELECT doc_id, unnest(detected) AS e FROM det)"),
        "keep_fn_filter": _merge_ctes() + f" SELECT doc_id, seq, value, entity_type FROM ner WHERE NOT (entity_type = 'nome_cognome' AND length({words}[1]) = length({words}[-1]))",
        "detect_ids_ch_it": _detected_ids(ids) + " SELECT doc_id, seq, value, category, entity_type, confidence FROM e",
        "context_boost": _detected_ids(ids) + f" SELECT doc_id, seq, value, entity_type, confidence FROM e WHERE {base}",
        "detect_iban_mod97": _detected_ids(_recs("IBAN_CODE")) + " SELECT doc_id, seq, value, entity_type FROM e",
        "wide_filters": _detected_ids(CAT.WIDE) + " SELECT doc_id, seq, value, category, entity_type FROM e",
    }
