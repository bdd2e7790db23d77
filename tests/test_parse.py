"""Model output parsing and value cleaning."""

from pyspark.sql import functions as F

from sparkredact.functions.text import clean_model_value
from sparkredact.operators import parse as P


def _parse(spark, raw, stage="entities"):
    df = spark.createDataFrame([(1, stage, raw)], "doc_id long, stage string, raw string")
    return df


def _ents(spark, raw, cats=None):
    return [(r.value, r.category, r.entity_type) for r in
            P.parse_model_entities(_parse(spark, raw), cats).orderBy("seq").collect()]


def test_clean_json(spark):
    raw = '{"entities": [{"value": "Marta Bianchi", "category": "persone_fisiche", "entity_type": "nome_cognome"}]}'
    assert _ents(spark, raw) == [("Marta Bianchi", "persone_fisiche", "nome_cognome")]


def test_fenced_and_prose(spark):
    raw = 'Here:\n```json\n{"entities": [{"value": "a@b.it", "category": "dati_contatto", "entity_type": "indirizzo_email"}]}\n```'
    assert _ents(spark, raw) == [("a@b.it", "dati_contatto", "email")]


def test_no_json_malformed_single_quotes(spark):
    assert _ents(spark, "no json here") == []
    assert _ents(spark, '{"entities": [{"value": "x"') == []
    assert _ents(spark, "{'entities': [{'value': 'x', 'category': 'persone_fisiche'}]}") == []


def test_bad_category_missing_value_default_type_filter(spark):
    raw = ('{"entities": [{"value": "A", "category": "bogus"}, {"category": "persone_fisiche"},'
           ' {"value": "Mario Rossi", "category": "persone_fisiche"},'
           ' {"value": "m@x.it", "category": "dati_contatto", "entity_type": "email"}]}')
    assert _ents(spark, raw) == [("Mario Rossi", "persone_fisiche", "unknown"), ("m@x.it", "dati_contatto", "email")]
    assert _ents(spark, raw, ["dati_contatto"]) == [("m@x.it", "dati_contatto", "email")]


def test_bundled_values_rejected(spark):
    raw = ('{"entities": [{"value": "Via Roma 1 | a@b.it | 0212", "category": "dati_contatto", "entity_type": "indirizzo"},'
           ' {"value": "' + "x" * 130 + '", "category": "dati_contatto", "entity_type": "url"}]}')
    assert _ents(spark, raw) == []


def test_clean_value_rules(spark):
    df = spark.createDataFrame([("Marta Bianchi\n- Data di nascita",), ("Marta Bianchi - Data di nascita: 1",),
                                ("Acme S.p.A. Sede: Milano",), ("**Mario Rossi**:",), ("Data di nascita",)], "v string")
    got = [r.c for r in df.select(clean_model_value(F.col("v")).alias("c")).collect()]
    # strip("-*_#") stops at the trailing colon, as str.strip does; B9 rejects the "**" later
    assert got == ["Marta Bianchi", "Marta Bianchi", "Acme S.p.A.", "Mario Rossi**", "Data di nascita"]


def test_assignments_normalised_last_wins(spark):
    raw = ('{"assignments": [{"value": " Mario ", "role": "Datore di Lavoro"}, {"value": "", "role": "x"},'
           ' {"value": "Mario", "role": "candidato"}, {"value": "Acme", "role": ""}]}')
    rows = P.parse_assignments(_parse(spark, raw, "roles")).collect()
    assert [(r.value, r.role) for r in rows] == [("Mario", "candidato")]
