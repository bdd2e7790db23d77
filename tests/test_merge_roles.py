"""Detector merge, legal re-typing, roles and retention on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from sparkredact.operators import governance as G
from sparkredact.operators import merge as M
from sparkredact.operators import roles as RO

E = "doc_id long, seq int, value string, category string, entity_type string, confidence double, source string"


def test_merge_semantic_needs_confirmation_structural_unless_covered(spark):
    ner = spark.createDataFrame([
        (1, 1, "Marta Bianchi", "persone_fisiche", "nome_cognome", 0.85, "ner"),   # confirmed
        (1, 2, "Sole Luna", "persone_fisiche", "nome_cognome", 0.85, "ner"),       # unconfirmed
        (1, 3, "a@b.it", "dati_contatto", "email", 1.0, "ner"),                  # covered by same type
        (1, 4, "+39 02 1234 5678", "dati_contatto", "telefono", 0.75, "ner"),    # new
        (1, 5, "mail.example.com", "dati_contatto", "url", 0.6, "ner"),          # inside model e-mail
    ], E)
    llm = spark.createDataFrame([
        (1, 1, "Marta Bianchi", "persone_fisiche", "nome_cognome", None, "llm"),
        (1, 2, "a@b.it", "dati_contatto", "email", None, "llm"),
        (1, 3, "x@mail.example.com", "dati_contatto", "email", None, "llm"),
    ], E)
    out = M.merge(ner, llm).orderBy("seq").collect()
    assert [(r.value, r.source) for r in out] == [
        ("Marta Bianchi", "llm"), ("a@b.it", "llm"), ("x@mail.example.com", "llm"),
        ("Marta Bianchi", "merged"), ("+39 02 1234 5678", "merged")]


def test_legal_reclassification(spark):
    ents = spark.createDataFrame([
        (1, 1, "Delta S.r.l.", "persone_fisiche", "nome_cognome", None, "llm"),
        (1, 2, "Nordwind", "persone_fisiche", "nome_cognome", None, "llm"),
        (1, 3, "Mario Rossi", "persone_fisiche", "nome_cognome", None, "llm")], E)
    docs = spark.createDataFrame([(1, "Nordwind, sede legale a Milano." + "x" * 250 + " Mario Rossi")], "doc_id long, content string")
    out = {r.value: r.category for r in M.reclassify_legal(ents, docs).collect()}
    assert out == {"Delta S.r.l.": "persone_giuridiche", "Nordwind": "persone_giuridiche", "Mario Rossi": "persone_fisiche"}


def test_proximity_200_vs_201(spark):
    text = "Mario Rossi" + " " * 189 + "a@b.it" + " " * 300 + "c@d.it"
    ents = spark.createDataFrame([
        (1, 1, "Mario Rossi", "persone_fisiche", "nome_cognome", None, "llm"),
        (1, 2, "a@b.it", "dati_contatto", "email", None, "llm"),
        (1, 3, "c@d.it", "dati_contatto", "email", None, "llm")], E)
    docs = spark.createDataFrame([(1, text)], "doc_id long, content string")
    asg = spark.createDataFrame([(1, "Mario Rossi", "candidato")], "doc_id long, value string, role string")
    own = spark.createDataFrame([], "doc_id long, value string, owner_role string")
    out = {r.value: r.semantic_role for r in RO.assign_all_roles(ents, docs, asg, own).collect()}
    assert out == {"Mario Rossi": "candidato", "a@b.it": "candidato", "c@d.it": None}


def test_no_actor_means_no_roles(spark):
    ents = spark.createDataFrame([(1, 1, "a@b.it", "dati_contatto", "email", None, "llm")], E)
    docs = spark.createDataFrame([(1, "a@b.it")], "doc_id long, content string")
    own = spark.createDataFrame([(1, "a@b.it", "candidato")], "doc_id long, value string, owner_role string")
    asg = spark.createDataFrame([], "doc_id long, value string, role string")
    assert RO.assign_all_roles(ents, docs, asg, own).first().semantic_role is None


def test_ttl_and_lru(spark):
    t = dt.datetime(2024, 1, 31)
    entries = spark.createDataFrame([
        (1, t - dt.timedelta(days=8), t - dt.timedelta(hours=1), 40),
        (2, t - dt.timedelta(days=1), t - dt.timedelta(hours=3), 40),
        (3, t - dt.timedelta(days=2), t - dt.timedelta(hours=2), 40)],
        "doc_id long, created_at timestamp, last_accessed timestamp, size_bytes long")
    live = sorted(r.doc_id for r in G.ttl_live(entries, F.lit(t)).collect())
    assert live == [2, 3]
    kept = sorted(r.doc_id for r in G.lru_keep(entries, 80).collect())
    assert kept == [1, 3]                      # least recently used (2) evicted


def test_stream_matches_batch(spark, tmp_path):
    from sparkredact.streaming import redact_stream as RS
    src = "/root/testdata/sf0.001"
    q = RS.start(spark, src, str(tmp_path / "out"), glob="documents.parquet",
                 checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = RS.redact_stream_df(spark.read.parquet(f"{src}/documents.parquet"))
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == 0


def test_same_type_propagation_first_donor_wins(spark):
    E2 = E + ", actor boolean, semantic_role string, doc_type string"
    rows = [
        (1, 1, "Delta S.r.l.", "persone_giuridiche", "nome_azienda", None, "llm", True, "fornitore", None),
        (1, 2, "Delta Group S.r.l.", "persone_giuridiche", "nome_azienda", None, "llm", True, "cliente", None),
        (1, 3, "Delta S.r.l", "persone_giuridiche", "nome_azienda", None, "llm", True, None, None),
        (1, 4, "Delta", "dati_contatto", "indirizzo", None, "llm", False, None, None),
        (1, 5, "Group", "persone_giuridiche", "nome_azienda", None, "llm", True, None, None),
    ]
    df = spark.createDataFrame(rows, E2)
    out = {r.seq: r.semantic_role for r in RO.propagate_same_type(df).collect()}
    # seq 3: "delta s.r.l" inside donors 1 and 2 -> first donor by seq (1)
    # seq 4: other entity type, no donor; seq 5: only donor 2 contains it
    assert out == {1: "fornitore", 2: "cliente", 3: "fornitore", 4: None, 5: "cliente"}
