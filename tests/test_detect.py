"""Recognisers, checksums, context boost and the detector filters."""

from pyspark.sql import functions as F

from sparkredact.functions import checks
from sparkredact.functions import recognizers as R
from sparkredact.operators import detect as D


def _detect(spark, text, lang="it", recs=None):
    df = spark.createDataFrame([(1, text, lang)], "doc_id long, content string, language string")
    return [(r.value, r.entity_type, r.confidence) for r in D.detect(df, recognizers=recs).orderBy("seq").collect()]


def _types(rows):
    return [t for _, t, _ in rows]


def test_plate_alone_and_in_sentence(spark):
    rows = _detect(spark, "Targa AB123CD del veicolo", recs=[r for r in R.STRUCTURAL if r.detector_type == "IT_LICENSE_PLATE"])
    assert rows == [("AB123CD", "targa", 0.85)]          # context word boosts 0.5 -> 0.85


def test_plate_negative_cases(spark):
    recs = [r for r in R.STRUCTURAL if r.detector_type == "IT_LICENSE_PLATE"]
    assert _detect(spark, "ab123cd", recs=recs) == []      # lower case
    assert _detect(spark, "AB1234CD", recs=recs) == []     # too long
    assert _detect(spark, "AB12CD", recs=recs) == []       # too short


def test_id_cards_do_not_collide(spark):
    recs = [r for r in R.STRUCTURAL if r.detector_type.startswith("IT_IDENTITY")]
    rows = _detect(spark, "CI AX1234567 e CIE CA12345AB", recs=recs)
    assert sorted(v for v, _, _ in rows) == ["AX1234567", "CA12345AB"]


def test_avs_and_vat_context(spark):
    recs = [r for r in R.STRUCTURAL if r.detector_type in ("CH_AVS_NUMBER", "IT_PARTITA_IVA")]
    rows = _detect(spark, "AHV 756.1234.5678.97, P.IVA 12345678901", recs=recs)
    assert ("756.1234.5678.97", "numero_avs", 1.0) in rows
    assert ("12345678901", "partita_iva", 0.75) in rows    # 0.4 + 0.35
    assert _detect(spark, "numero 12345678901", recs=recs) == [("12345678901", "partita_iva", 0.4)]


def test_checksums(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "GB82WEST12345698765432", "192.168.1.1", "AB1234563")],
                               "card string, iban string, ip string, dea string")
    r = df.select(checks.luhn_valid(F.col("card")).alias("a"), checks.luhn_valid(F.lit("4111111111111112")).alias("b"),
                  checks.iban_valid(F.col("iban")).alias("c"), checks.iban_valid(F.lit("GB82WEST12345698765431")).alias("d"),
                  checks.ipv4_valid(F.col("ip")).alias("e"), checks.ipv4_valid(F.lit("300.1.1.1")).alias("f")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (True, False, True, False, True, False)


def test_structural_types_bypass_deny_list(spark):
    rows = _detect(spark, "Email: email@example.com")
    assert ("email@example.com", "email", 1.0) in rows


def test_deny_list_exact_first_line_prefix_and_iban_fragment(spark):
    df = spark.createDataFrame(
        [("Curriculum Vitae", "PERSON", "it"), ("Formazione:\n- Laurea", "PERSON", "it"),
         ("Profilo Project Manager", "PERSON", "it"), ("IT60 X054", "LOCATION", "it"),
         ("IT60X0542811101000000123456", "LOCATION", "it"), ("Marta Bianchi", "PERSON", "it"),
         ("Adresse", "LOCATION", "de"), ("Adresse", "LOCATION", "en"), ("Nome", "EMAIL_ADDRESS", "it")],
        "value string, t string, lang string")
    got = [r.fp for r in df.select(D.is_semantic_false_positive(F.col("value"), F.col("t"), F.col("lang")).alias("fp")).collect()]
    assert got == [True, True, True, True, False, False, True, False, False]


def test_fiscal_code_reclassified_and_dates_filtered(spark):
    rows = _detect(spark, "Sig. Rossi Mario\nRSSMRA85T10A562S\nil 12/03/2020 alle ore 10")
    assert ("RSSMRA85T10A562S", "codice_fiscale", 0.7) in rows
    assert ("12/03/2020", "data_evento", 0.85) in rows


def test_dedup_packed_keeps_best_at_first_position(spark):
    df = spark.createDataFrame([(1, [(1, "Milano", "indirizzo", 0.5), (2, "x", "email", 1.0), (3, "milano", "indirizzo", 0.9)])],
                               "doc_id long, arr array<struct<seq:int,value:string,entity_type:string,confidence:double>>")
    out = df.select(D.dedup_detected_array(F.col("arr")).alias("d")).first().d
    assert [(e.seq, e.value, e.confidence) for e in out] == [(1, "milano", 0.9), (2, "x", 1.0)]
