"""Derived test corpus: personal-data documents built from the TPC-H-style tables.

The driver's ``documents`` table holds e-mails, phones, cards and IPs but no
names, companies, IBANs or national identifiers, and no model outputs.  These
SQL texts build, from ``customer`` (one document per row), ``nation``,
``orders`` (first order date) and ``supplier`` (counterparty):

* ``DOCS``       -- doc_id, filename, content, language, doc_kind
* ``MODEL``      -- doc_id, stage ('entities' | 'roles' | 'ownership'), raw
                    model text with planted faults (code fences, prose around
                    the JSON, truncation, aliases, bundled values, wrong
                    categories)
* ``TRUTH``      -- doc_id, value, category: the planted entities

They only lay out input rows in the schemas the pipeline reads; none of the
pipeline's work is done here.  The same SQL text runs on Spark (via
``spark.sql`` with DataFrame arguments) and on DuckDB (the oracle), so both
engines see identical inputs.  Only functions with identical semantics in
both are used (``||``, ``concat_ws``, ``lpad``, ``chr``, ``substr``, CASE).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as T


def _case(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {expr} {whens} END)"


def _num(expr: str, width: int) -> str:
    return f"lpad(cast({expr} AS string), {width}, '0')"


def _div(expr: str, d: int) -> str:
    return f"cast(floor(({expr}) / {d}) AS bigint)"


K = "c.c_custkey"
NL = "chr(10)"
BS_N = "(chr(92) || 'n')"          # backslash-n inside JSON text
QT = "chr(34)"                     # double quote

_FIRST = ["Marta", "Luca", "Giulia", "Paul", "Claire", "Jürgen", "Sophie", "Élodie",
          "Marco", "Anna", "Thomas", "Chiara"]
_LAST = ["Rossi", "Bianchi", "Mueller", "Dupont", "Smith", "Ferrari", "Schmidt",
         "Martin", "Brown", "Colombo"]
_ORG = ["Delta", "Nordlicht", "Acme", "Lumen", "Orizzonte", "Helvetia", "Vertex", "Sirio"]
_SUFFIX = ["S.r.l.", "GmbH", "Ltd", "SA", "S.p.A."]
_CITY = ["Milano", "Torino", "Zürich", "Genève", "Lyon", "Berlin", "London", "Roma"]
_STREET = ["Via Garibaldi", "Viale Monza", "Rue Victor", "Corso Italia", "Via Dante"]
_INST = ["Università di Bologna", "University of Leeds", "Technische Universität München",
         "Université de Lyon", "Politecnico di Milano"]
_IBAN = ["IT60X0542811101000000123456", "DE89370400440532013000", "GB82WEST12345698765432",
         "FR1420041010050500013M02606", "CH9300762011623852957"]
_CARD = ["4111 1111 1111 1111", "5500 0055 5555 5559", "4012888888881881", "4111 1111 1111 1112"]
_KIND = ["cv", "medical", "legal", "contract", "invoice", "letter"]


def _fields(o: str = "o", s: str = "s") -> str:
    """Per-customer field expressions (SELECT list of the ``f`` CTE); ``o`` has the
    first order's date, ``s`` the counterparty."""
    first = _case(f"{K} % 12", _FIRST)
    last = _case(f"{_div(K, 12)} % 10", _LAST)
    org = _case(f"{K} % 8", _ORG) + " || ' ' || " + _case(f"{_div(K, 8)} % 5", _SUFFIX)
    sup = _case(f"{s}.s_suppkey % 8", _ORG) + " || ' ' || " + _case(f"{_div(f'{s}.s_suppkey', 8)} % 5", _SUFFIX)
    city = _case("c.c_nationkey % 8", _CITY)
    letters = "'ABCDEHLMPRST'"
    cf = (f"'RSS' || chr(65 + cast({K} % 26 AS int)) || chr(65 + cast(({K} * 7) % 26 AS int)) "
          f"|| chr(65 + cast(({K} * 3) % 26 AS int)) || {_num(f'{K} % 100', 2)} "
          f"|| substr({letters}, cast({K} % 12 AS int) + 1, 1) || {_num(f'{K} % 28 + 1', 2)} "
          f"|| chr(65 + cast(({K} * 5) % 26 AS int)) || {_num(f'{K} % 1000', 3)} "
          f"|| chr(65 + cast(({K} * 11) % 26 AS int))")
    iban_plain = _case(f"{K} % 5", _IBAN)
    iban = (f"CASE WHEN {K} % 7 = 0 THEN substr({iban_plain}, 1, length({iban_plain}) - 1) || "
            f"CASE WHEN substr({iban_plain}, length({iban_plain}), 1) = '9' THEN '1' ELSE '9' END "
            f"ELSE {iban_plain} END")
    plate = (f"chr(65 + cast({K} % 26 AS int)) || chr(65 + cast({_div(K, 26)} % 26 AS int)) || "
             f"{_num(f'{K} % 1000', 3)} || chr(65 + cast(({K} * 7) % 26 AS int)) || "
             f"chr(65 + cast(({K} * 3) % 26 AS int))")
    avs = (f"'756.' || {_num(f'{K} % 10000', 4)} || '.' || {_num(f'({K} * 13) % 10000', 4)} "
           f"|| '.' || {_num(f'{K} % 100', 2)}")
    piva = _num(f"({K} * 7919) % 100000000000", 11)
    dob = (f"{_num(f'{K} % 28 + 1', 2)} || '/' || {_num(f'{K} % 12 + 1', 2)} || '/' || "
           f"cast(1950 + {K} % 50 AS string)")
    first_order = f"{o}.first_order"
    cdate = (f"CASE WHEN {first_order} IS NULL THEN NULL ELSE "
             + _num(f"day({first_order})", 2) + " || '/' || " + _num(f"month({first_order})", 2)
             + f" || '/' || cast(year({first_order}) AS string) END")
    street = _case(f"{K} % 5", _STREET) + " || ' ' || cast(" + f"{K} % 200 + 1 AS string)"
    return f"""
      {K} AS doc_id,
      {_case(f'{K} % 6', _KIND)} AS doc_kind,
      {_case('c.c_nationkey % 4', ['it', 'en', 'fr', 'de'])} AS language,
      {first} || ' ' || {last} AS person,
      {dob} AS dob,
      {city} AS city,
      {street} AS street,
      'c' || cast({K} AS string) || '.' || lower({last}) || '@example.com' AS email,
      '+39 02 ' || {_num(f'{K} % 10000', 4)} || ' ' || {_num(f'({K} * 7) % 10000', 4)} AS phone,
      {cf} AS cf,
      {iban} AS iban,
      {_case(f'{K} % 4', _CARD)} AS card,
      {plate} AS plate,
      {avs} AS avs,
      {piva} AS piva,
      {org} AS company,
      {sup} AS supplier,
      lower({_case(f'{K} % 8', _ORG)}) AS web,
      {_case(f'{K} % 5', _INST)} AS institution,
      {cdate} AS contract_date,
      {K} % 97 AS r"""


def _joins(customer: str, orders: str, supplier: str, select: str) -> tuple[str, str]:
    """``ord`` (the first order of each customer), and ``select`` of its joins."""
    return f"""
    ord AS (SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey)""", f"""
      SELECT {select}
      FROM {customer} c
      LEFT JOIN ord o ON o.o_custkey = c.c_custkey
      LEFT JOIN {supplier} s ON s.s_suppkey = c.c_custkey % (SELECT count(*) FROM {supplier})
    """


def _base(customer: str, orders: str, supplier: str, joined: str | None = None) -> str:
    """``joined`` names a view that has the joins already (``joined_rows``)."""
    if joined:
        return f"f AS (SELECT {_fields('c', 'c')} FROM {joined} c)"
    ord_, rows = _joins(customer, orders, supplier, _fields())
    return f"{ord_},\n    f AS ({rows})"


def _labels(lang: str) -> dict:
    def pick(it, en, fr, de):
        return f"(CASE {lang} WHEN 'it' THEN '{it}' WHEN 'en' THEN '{en}' WHEN 'fr' THEN '{fr}' ELSE '{de}' END)"
    return {
        "name": pick("Nome", "Name", "Nom", "Name"),
        "dob": pick("Data di nascita", "Date of birth", "Date de naissance", "Geburtsdatum"),
        "pob": pick("Luogo di nascita", "Place of birth", "Lieu de naissance", "Geburtsort"),
        "addr": pick("Indirizzo", "Address", "Adresse", "Adresse"),
        "phone": pick("Telefono", "Phone", "Téléphone", "Telefon"),
        "cf": pick("Codice fiscale", "Tax code", "Code fiscal", "Steuernummer"),
        "plate": pick("Targa", "Vehicle", "Véhicule", "Fahrzeug"),
        "company": pick("Sede legale", "Registered office", "Siège social", "Firmensitz"),
        "date": pick("Data contratto", "Contract date", "Date du contrat", "Vertragsdatum"),
        "personal": pick("Dati Personali", "Personal Data", "Données Personnelles", "Persönliche Daten"),
    }


def _header() -> str:
    return """CASE doc_kind
      WHEN 'cv' THEN '# Curriculum Vitae'
      WHEN 'medical' THEN (CASE language WHEN 'it' THEN '# Cartella clinica' WHEN 'en' THEN '# Medical record'
                           WHEN 'fr' THEN '# Dossier médical' ELSE '# Krankenakte' END)
      WHEN 'legal' THEN '# Tribunale di ' || city || ' - Ricorso'
      WHEN 'contract' THEN (CASE language WHEN 'it' THEN '# Contratto di locazione' ELSE '# Contract - Art. 1' END)
      WHEN 'invoice' THEN (CASE language WHEN 'it' THEN '# Fattura n. ' ELSE '# Invoice no. ' END) || cast(doc_id AS string)
      ELSE '# Gentile ' || person END"""


def docs_sql(customer="customer", orders="orders", supplier="supplier", joined: str | None = None) -> str:
    L = _labels("language")
    lines = [
        _header(),
        f"CASE WHEN doc_kind = 'cv' THEN '## ' || {L['personal']} END",
        f"{L['name']} || ': ' || person",
        f"{L['dob']} || ': ' || dob",
        f"{L['pob']} || ': ' || city",
        f"{L['addr']} || ': ' || street || ', ' || city",
        "'Email: ' || email",
        f"{L['phone']} || ': ' || phone",
        f"{L['cf']} || ': ' || cf",
        "'IBAN: ' || iban",
        "CASE WHEN r % 2 = 0 THEN 'Carta: ' || card END",
        f"CASE WHEN r % 3 = 0 THEN {L['plate']} || ' ' || plate ELSE 'Auto ' || plate END",
        "CASE WHEN language IN ('de', 'fr') THEN 'AHV ' || avs END",
        f"{L['company']} || ': ' || company || ', P.IVA ' || piva",
        "'Fornitore: ' || supplier || ' - area ' || city",
        "CASE WHEN doc_kind = 'cv' THEN 'Formazione: ' || institution END",
        "'Web: https://www.' || web || '.example.com'",
        f"CASE WHEN contract_date IS NOT NULL THEN {L['date']} || ': ' || contract_date END",
        "'Referente ' || person || ' per ' || company || '.'",
    ]
    body = f"concat_ws({NL}, " + ", ".join(lines) + ")"
    return f"""WITH {_base(customer, orders, supplier, joined)}
    SELECT doc_id, 'doc_' || cast(doc_id AS string) || '_' || upper(language) || '.md' AS filename,
           {body} AS content, language, doc_kind
    FROM f"""


def model_sql(customer="customer", orders="orders", supplier="supplier", wide: bool = False, joined: str | None = None) -> str:
    """Model outputs per document: three stages with planted faults, a row a
    stage; ``wide``: a column a stage."""
    def item(value, category, etype):
        return ("'{\"value\": \"' || " + value + " || '\", \"category\": \"" + category
                + "\", \"entity_type\": \"' || " + etype + " || '\"}'")
    name_val = f"CASE WHEN r % 9 = 0 THEN person || {BS_N} || '- Data di nascita: ' || dob ELSE person END"
    items = [
        item(name_val, "persone_fisiche", "'nome_cognome'"),
        item("dob", "persone_fisiche", "'data_nascita'"),
        "CASE WHEN r % 4 = 0 THEN " + item("dob", "dati_temporali", "'data_evento'") + " END",
        item("city", "persone_fisiche", "'luogo_nascita'"),
        item("email", "dati_contatto", "CASE WHEN r % 5 = 0 THEN 'indirizzo_email' ELSE 'email' END"),
        item("phone", "dati_contatto", "CASE WHEN r % 3 = 0 THEN 'numero_telefono' ELSE 'telefono' END"),
        item("street || ', ' || city", "dati_contatto", "'indirizzo'"),
        "CASE WHEN r % 7 = 0 THEN " + item("company", "persone_fisiche", "'nome_cognome'")
        + " ELSE " + item("company", "persone_giuridiche", "'nome_azienda'") + " END",
        item("supplier", "persone_giuridiche", "'nome_azienda'"),
        item("cf", "identificativi", "'codice_fiscale'"),
        # a code cut short, which the final shape check drops
        "CASE WHEN r % 8 = 3 THEN " + item("substr(cf, 1, 10)", "identificativi", "'codice_fiscale'") + " END",
        # a longer form of the company, which no role assignment names
        "CASE WHEN r % 6 = 1 THEN " + item("company || ' Group'", "persone_giuridiche", "'nome_azienda'") + " END",
        item("iban", "dati_finanziari", "'iban'"),
        item("plate", "identificativi", "'targa_auto'"),
        "CASE WHEN contract_date IS NOT NULL THEN " + item("contract_date", "dati_temporali", "'data_contratto'") + " END",
        "CASE WHEN r % 11 = 0 THEN " + item("'Referente'", "categoria_ignota", "'altro'") + " END",
        "CASE WHEN r % 13 = 0 THEN " + item("street || ' | ' || email || ' | ' || phone", "dati_contatto", "'indirizzo'") + " END",
        "CASE WHEN r % 6 = 0 THEN '{\"value\": \"' || person || '\", \"category\": \"persone_fisiche\"}' END",
    ]
    ent_json = "'{\"entities\": [' || concat_ws(', ', " + ", ".join(items) + ") || ']}'"
    role = """CASE doc_kind WHEN 'cv' THEN (CASE WHEN r % 10 = 0 THEN 'Paziente' ELSE 'candidato' END)
                WHEN 'medical' THEN 'paziente' WHEN 'legal' THEN 'ricorrente'
                WHEN 'contract' THEN (CASE WHEN r % 2 = 0 THEN 'datore di lavoro' ELSE 'conduttore' END)
                WHEN 'invoice' THEN 'cliente' ELSE 'destinatario' END"""
    org_role = "CASE doc_kind WHEN 'cv' THEN 'azienda_cliente' ELSE 'azienda fornitrice' END"
    roles_json = ("'{\"assignments\": [{\"value\": \"' || person || '\", \"role\": \"' || role || '\"}, "
                  "{\"value\": \"' || company || '\", \"role\": \"' || org_role || '\"}, "
                  "{\"value\": \"' || supplier || '\", \"role\": \"fornitore\"}]}'")
    own_items = [
        "'{\"value\": \"' || email || '\", \"owner_role\": \"' || role_n || '\"}'",
        "'{\"value\": \"' || phone || '\", \"owner_role\": \"' || CASE WHEN r % 2 = 0 THEN 'persona' ELSE role_n END || '\"}'",
        "'{\"value\": \"' || dob || '\", \"owner_role\": \"' || role_n || '\"}'",
        "'{\"value\": \"' || iban || '\", \"owner_role\": \"' || org_role_n || '\"}'",
        "'{\"value\": \"' || cf || '\", \"owner_role\": \"' || CASE WHEN r % 5 = 0 THEN 'documento' ELSE role_n END || '\"}'",
    ]
    own_json = "'{\"ownership\": [' || concat_ws(', ', " + ", ".join(own_items) + ") || ']}'"

    def fault(j: str) -> str:
        return (f"CASE WHEN r % 17 = 0 THEN substr({j}, 1, cast(floor(length({j}) / 2) AS int)) "
                f"WHEN r % 3 = 1 THEN '```json' || {NL} || {j} || {NL} || '```' "
                f"WHEN r % 5 = 2 THEN 'Here is the result:' || {NL} || {j} || {NL} || 'Done.' "
                f"ELSE {j} END")
    laid_out = f"""WITH {_base(customer, orders, supplier, joined)},
    g AS (SELECT f.*, {role} AS role, {org_role} AS org_role FROM f),
    h AS (SELECT g.*, lower(replace(role, ' ', '_')) AS role_n, lower(replace(org_role, ' ', '_')) AS org_role_n FROM g)"""
    if wide:
        return f"""{laid_out}
    SELECT doc_id, {fault(ent_json)} AS entities, {fault(roles_json)} AS roles, {fault(own_json)} AS ownership FROM h"""
    return f"""{laid_out}
    SELECT doc_id, 'entities' AS stage, {fault(ent_json)} AS raw FROM h
    UNION ALL
    SELECT doc_id, 'roles' AS stage, {fault(roles_json)} AS raw FROM h
    UNION ALL
    SELECT doc_id, 'ownership' AS stage, {fault(own_json)} AS raw FROM h"""


_PLANTED = [
    ("person", "persone_fisiche"), ("dob", "persone_fisiche"), ("email", "dati_contatto"),
    ("phone", "dati_contatto"), ("street || ', ' || city", "dati_contatto"),
    ("company", "persone_giuridiche"), ("supplier", "persone_giuridiche"),
    ("cf", "identificativi"), ("iban", "dati_finanziari"), ("plate", "identificativi"),
    ("contract_date", "dati_temporali"),
]


def truth_sql(customer="customer", orders="orders", supplier="supplier", wide: bool = False, joined: str | None = None) -> str:
    """Planted entities: (doc_id, value, category); ``wide``: a column a value."""
    if wide:
        return (f"WITH {_base(customer, orders, supplier, joined)} SELECT doc_id, language, "
                + ", ".join(f"{v} AS v{i}" for i, (v, _) in enumerate(_PLANTED)) + " FROM f")
    sel = " UNION ALL ".join(
        f"SELECT doc_id, language, {v} AS value, '{c}' AS category FROM f WHERE {v} IS NOT NULL"
        for v, c in _PLANTED)
    return f"WITH {_base(customer, orders, supplier, joined)} {sel}"


def identifiers_sql(customer="customer") -> str:
    """A document per customer with the identifiers no other table holds: identity
    cards on paper and electronic, social insurance and VAT numbers, plates, fiscal
    codes, medical licences, wallets, IBANs, and dates that are none; each well and
    badly formed, and with or without a word of context before it."""
    n = "c_custkey"
    letter = lambda k: f"chr(65 + cast(({n} * {k}) % 26 AS int))"
    card7 = _num(f"({n} * 37) % 10000000", 7)
    d = [f"(({n} * {k}) % 10)" for k in (3, 7, 11, 13, 17, 19)]
    check = f"(({d[0]} + {d[2]} + {d[4]} + 2 * ({d[1]} + {d[3]} + {d[5]})) % 10)"
    licence = " || ".join(["'B'", letter(3), *[f"cast({x} AS string)" for x in d], f"cast(({check} + CASE WHEN {n} % 4 = 0 THEN 1 ELSE 0 END) % 10 AS string)"])
    code = f"'VRD' || {letter(3)} || {letter(7)} || {letter(9)} || {_num(f'{n} % 100', 2)} || 'A' || {_num(f'{n} % 28 + 1', 2)} || 'H' || {_num(f'{n} % 1000', 3)} || {letter(11)}"
    iban = _case(f"{n} % 5", _IBAN)
    gap = f"CASE WHEN {n} % 3 = 0 THEN 'rif. ' ELSE '' END || "
    lines = [
        f"CASE WHEN {n} % 2 = 0 THEN 'Carta di identità ' ELSE 'Codice ' END || {letter(5)} || {letter(9)} || {card7}",
        f"CASE WHEN {n} % 2 = 1 THEN 'CIE ' ELSE 'Sigla ' END || {letter(7)} || {letter(3)} || {_num(f'{n} % 100000', 5)} || {letter(5)} || {letter(11)}",
        f"CASE WHEN {n} % 3 = 1 THEN 'AHV ' ELSE 'Nr. ' END || {gap}'756.' || {_num(f'{n} % 10000', 4)} || '.' || {_num(f'({n} * 7) % 10000', 4)} || '.' || {_num(f'{n} % 100', 2)}",
        f"CASE WHEN {n} % 3 = 2 THEN 'P.IVA ' ELSE 'Nr. ' END || {_num(f'({n} * 7919) % 100000000000', 11)}",
        f"CASE WHEN {n} % 2 = 0 THEN 'Targa ' ELSE 'Sigla ' END || {letter(3)} || {letter(5)} || {_num(f'{n} % 1000', 3)} || {letter(7)} || {letter(9)}",
        f"'Codice fiscale ' || CASE WHEN {n} % 4 = 1 THEN substr({code}, 1, 15) || '9' ELSE {code} END",
        f"'Licence ' || {licence}",
        f"'Wallet 1' || replace(replace({_num(f'({n} * 7919) % 100000000', 8)}, '0', 'x'), '1', 'y') || 'BoatSLRHtKNngkdXEeobR7'",
        f"'IBAN ' || CASE WHEN {n} % 5 = 0 THEN substr({iban}, 1, 6) || '99' || substr({iban}, 9) ELSE {iban} END",
        f"'Da ' || cast({n} % 30 + 1 AS string) || ' anni, dal ' || {_num(f'{n} % 28 + 1', 2)} || '/' || {_num(f'{n} % 12 + 1', 2)} || '/' || cast(1990 + {n} % 30 AS string)",
    ]
    return f"SELECT {n} AS doc_id, concat_ws({NL}, {', '.join(lines)}) AS content, 'it' AS language FROM {customer}"


# Documents that one task lays out: a few columns of small rows become texts.
LAID_OUT_PER_TASK = 50_000


def _views(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Temp views named per input folder, and ``joined``: their joins, a row a document.

    The joins are small rows, which the engine packs into few partitions by their
    bytes, so they are dealt out by their number before texts are laid out."""
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    names = {n: f"sr_{n}_{tag}" for n in ("customer", "orders", "supplier")}
    for n, view in names.items():
        T.table(spark, sf_dir, n).createOrReplaceTempView(view)
    ord_, rows = _joins(*names.values(), "c.c_custkey, c.c_nationkey, o.first_order, s.s_suppkey")
    names["joined"] = f"sr_joined_{tag}"
    spark.sql(f"WITH {ord_} {rows}").repartition(partitions(spark, sf_dir, LAID_OUT_PER_TASK), "c_custkey").createOrReplaceTempView(names["joined"])
    return names


def partitions(spark: SparkSession, sf_dir: str, per_task: int | None = None) -> int:
    """Partitions for the derived documents, one a customer."""
    return T.partitions_for(T.table(spark, sf_dir, "customer"), per_task)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(docs_sql(**_views(spark, sf_dir)))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_sql`` from one pass over the base instead of one a stage."""
    wide = spark.sql(model_sql(**_views(spark, sf_dir), wide=True))
    return wide.select("doc_id", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("raw")) for s in ("entities", "roles", "ownership")])).alias("m")) \
               .select("doc_id", "m.stage", "m.raw")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``truth_sql`` from one pass over the base instead of one a value."""
    wide = spark.sql(truth_sql(**_views(spark, sf_dir), wide=True))
    planted = F.array(*[F.struct(F.col(f"v{i}").alias("value"), F.lit(c).alias("category")) for i, (_, c) in enumerate(_PLANTED)])
    return wide.select("doc_id", "language", F.explode(planted).alias("p")).select("doc_id", "language", "p.value", "p.category").where("value is not null")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "customer").select("c_custkey").repartition(partitions(spark, sf_dir, LAID_OUT_PER_TASK), "c_custkey")
    return spark.sql(identifiers_sql("{customer}"), customer=rows)
