"""Properties of the per-document folds (hypothesis-generated entity lists)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkredact.operators import redact as X

ENT = "array<struct<seq:int,value:string,category:string,entity_type:string,semantic_role:string>>"
WORDS = st.sampled_from(["Anna", "Rossi", "Anna Rossi", "Via Po 1", "Po", "a@b.it", "b.it", "12/03/2020"])
TYPES = st.sampled_from([("persone_fisiche", "nome_cognome"), ("dati_contatto", "indirizzo"),
                         ("dati_contatto", "email"), ("dati_temporali", "data_evento")])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(WORDS, TYPES), min_size=1, max_size=8))
def test_numbering_is_dense_per_label_and_values_are_replaced(spark, items):
    ents = [(i + 1, v, c, t, None) for i, (v, (c, t)) in enumerate(items)]
    content = " | ".join(v for v, _ in items)
    df = spark.createDataFrame([(ents, content, "it")], f"e {ENT}, content string, lang string")
    out = X.anonymize_packed(df, "e", language_col="lang").first()
    by_label = {}
    for m in out.mappings:
        label, n = m.replacement[1:-1].rsplit("_", 1)
        by_label.setdefault(label, []).append(int(n))
    for nums in by_label.values():
        assert nums == list(range(1, len(nums) + 1))
    # a kept original can only survive if a later replacement re-creates it
    originals = [m.original for m in out.mappings]
    for i, o in enumerate(originals):
        if o in out.anonymized:
            assert any(o in m.replacement for m in out.mappings[i + 1:]) or \
                any(o in r.replacement for r in out.mappings[:i])


def test_partitioning_does_not_change_output(spark):
    from sparkredact.streaming.redact_stream import redact_stream_df
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = redact_stream_df(docs.repartition(3))
    b = redact_stream_df(docs.repartition(7, "lang"))
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
