"""Placeholder labels, localisation, numbering, de-duplication, substitution."""

from pyspark.sql import functions as F

from sparkredact.functions.labels import label_for, localise
from sparkredact.operators import redact as X

ENT = "array<struct<seq:int,value:string,category:string,entity_type:string,semantic_role:string>>"


def _labels(spark, rows):
    df = spark.createDataFrame(rows, "category string, entity_type string, role string, lang string")
    lab = label_for(F.col("category"), F.col("entity_type"), F.col("role"))
    return [r.l for r in df.select(localise(lab, F.col("lang")).alias("l")).collect()]


def test_label_choice(spark):
    rows = [("persone_fisiche", "nome_cognome", "candidato", "it"),
            ("persone_fisiche", "nome_cognome", None, "it"),
            ("persone_giuridiche", "nome_azienda", "azienda fornitrice", "it"),
            ("persone_fisiche", "data_nascita", "candidato", "it"),
            ("persone_fisiche", "data_nascita", "documento", "it"),
            ("dati_contatto", "email", "candidato", "it"),
            ("dati_contatto", "email", "documento", "it"),
            ("dati_contatto", "strano", None, "it"),
            ("altro", "strano", None, "it")]
    assert _labels(spark, rows) == ["CANDIDATO", "PERSONA", "AZIENDA_FORNITRICE", "DATA_NASCITA_CANDIDATO",
                                    "DATA_NASCITA", "EMAIL_CANDIDATO", "EMAIL", "CONTATTO", "ENTITA"]


def test_localisation(spark):
    rows = [("persone_fisiche", "data_nascita", "candidato", "en"),
            ("persone_fisiche", "data_nascita", "candidato", "de"),
            ("persone_giuridiche", "nome_azienda", "societa_datrice_lavoro", "fr"),
            ("persone_fisiche", "nome_cognome", "ruolo_ignoto", "en"),
            ("dati_contatto", "telefono", None, "es")]
    assert _labels(spark, rows) == ["BIRTH_DATE_CANDIDATE", "GEBURTSDATUM_BEWERBER", "SOCIETE_EMPLOYEUR",
                                    "RUOLO_IGNOTO", "TELEFONO"]


def test_counter_is_per_localised_label(spark):
    df = spark.createDataFrame([([(1, "Dr Rossi", "persone_fisiche", "nome_cognome", "medico"),
                                  (2, "Dr Verdi", "persone_fisiche", "nome_cognome", "dottore")], "en")], f"e {ENT}, lang string")
    m = df.select(X.number_placeholders(F.col("e"), F.col("lang")).alias("m")).first().m
    assert [x.replacement for x in m] == ["[DOCTOR_1]", "[DOCTOR_2]"]


def test_greedy_dedup_and_sequential_substitution(spark):
    ents = [(1, "Marta Bianchi\n- Data", "persone_fisiche", "nome_azienda", None),
            (2, "Marta Bianchi", "persone_fisiche", "nome_cognome", None),
            (3, "Via Roma 1", "dati_contatto", "indirizzo", None),
            (4, "Roma", "dati_contatto", "indirizzo", None),
            (5, "Marta Bianchi", "persone_fisiche", "nome_cognome", None)]
    df = spark.createDataFrame([(ents, "Marta Bianchi vive in Via Roma 1.", "it")], f"e {ENT}, content string, lang string")
    out = X.anonymize_packed(df, "e", language_col="lang").first()
    assert [m.original for m in out.mappings] == ["Marta Bianchi", "Roma"]
    assert out.anonymized == "[PERSONA_1] vive in Via [INDIRIZZO_1] 1."
