"""The packed document record against the table forms of the same steps, and its scans against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sparkredact import vocab
from sparkredact.functions import value_scan as VS
from sparkredact.operators import detect as D
from sparkredact.operators import extract as EX
from sparkredact.operators import merge as M
from sparkredact.operators import parse as P
from sparkredact.operators import record as RC
from sparkredact.operators import redact as X
from sparkredact.operators import roles as RO
from sparkredact.plans import catalog
from sparkredact.session import apply_runtime_conf, materialize
from sparkredact.sources import derived as DV

SF = "/root/testdata/sf0.001"


def word(rng, alphabet="abc", most=6):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))


def test_related_rows_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        left, right = ([word(rng) if rng.random() > 0.1 else None for _ in range(rng.randint(0, 12))] for _ in range(2))
        for empty_too in (False, True):
            want = [[j for j, b in enumerate(right) if a is not None and b is not None and (empty_too or (a and b)) and (a in b or b in a)] for a in left]
            assert VS.related_rows(left, right, empty_too) == want


def test_near_phrase_equals_the_pattern():
    import re
    rng = random.Random(2)
    phrases = ["rea", "sede legale"]
    for _ in range(200):
        text = "".join(rng.choice(["rea", "sede legale", "ab", "aba", "x", "\n", "  "]) for _ in range(rng.randint(0, 25)))
        values = ["ab", "aba", "x\n", "area", None, "zz"]
        for window in (0, 3, 9):
            any_phrase = "(?:" + "|".join(phrases) + ")"
            want = [v is not None and bool(re.search(f"(?s){any_phrase}.{{0,{window}}}{re.escape(v)}|{re.escape(v)}.{{0,{window}}}{any_phrase}", text)) for v in values]
            assert VS.near_phrase(text, values, phrases, window) == want


def test_scans_of_many_values(monkeypatch):
    rng = random.Random(5)
    values = [word(rng, "abc", 4) for _ in range(3 * VS.FEW)] + [None]
    some, text = values[:VS.FEW], word(rng, "abcd", 300)
    for empty_too in (False, True):
        want = [VS.related_rows([v], some, empty_too)[0] for v in values]
        assert VS.related_rows(values, some, empty_too) == want
    assert VS.first_places(text, values) == [VS.first_places(text, [v])[0] for v in values]
    want = sorted((i, v) for v in {*values} - {None, ""} for i in range(len(text)) if text.startswith(v, i))
    assert sorted(VS.Finder(values)(text)) == want
    monkeypatch.setattr(VS, "FEW", 0)                 # few values, but by the automaton
    test_related_rows_equal_brute_force()
    test_near_phrase_equals_the_pattern()
    test_places_neighbours_and_single_pass()


def test_places_neighbours_and_single_pass():
    rng = random.Random(3)
    for _ in range(100):
        text = word(rng, "abc é𝒳", 40)
        values = [word(rng, "abcé𝒳", 3) for _ in range(6)] + [None]
        places = VS.first_places(text, values)
        assert places == [text.find(v) if v else -1 for v in values]
        for most in (0, 4):
            want = [[j for _, j in sorted((abs(q - p), j) for j, q in enumerate(places) if q >= 0 and j != i and abs(q - p) <= most)] if p >= 0 else []
                    for i, p in enumerate(places)]
            assert VS.neighbours(places, most) == want
        mapping = {v: f"[{i}{v}]" for i, v in enumerate(values) if v}
        out, at = "", 0
        while at < len(text):
            hit = max((v for v in mapping if text.startswith(v, at)), key=len, default="")
            out, at = (out + mapping[hit], at + len(hit)) if hit else (out + text[at], at + 1)
        assert VS.replace_once(text, mapping) == out
    assert VS.replace_once(None, {"a": "b"}) is None and VS.replace_once("", {}) == ""


def test_record_equals_the_table_forms(spark):
    """Identification and roles from one row a document, and from joins of entity tables."""
    docs, model = DV.documents(spark, SF), DV.model_outputs(spark, SF)
    rows = RC.with_roles(RC.identified(RC.judge(RC.assemble(docs, model))))
    got = RC.entity_rows(rows, "doc_type", semantic_role="role").drop("confidence").collect()
    apply_runtime_conf(spark)  # the joined plans are large
    kept = lambda df: materialize(spark, df, "form")
    docs, ner, llm = kept(docs), kept(D.detect(docs)), kept(P.parse_model_entities(model))
    asg, own = kept(P.parse_assignments(model)), kept(P.parse_ownership(model))
    want = RO.assign_all_roles(kept(M.identify(ner, llm, docs)), docs, asg, own).select(*got[0].__fields__).collect()
    assert len(got) == len(want) > 2000 and sorted(map(str, got)) == sorted(map(str, want))


def test_one_shuffle(spark):
    """Two exchanges for the documents and the outputs, none after."""
    docs = spark.createDataFrame([(1, "a", "it")], "doc_id long, content string, language string")
    model = spark.createDataFrame([(1, "entities", "{}")], "doc_id long, stage string, raw string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = RC.entity_rows(RC.with_roles(RC.identified(RC.judge(RC.assemble(docs, model)))), semantic_role="role")
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange ") == 2


MODEL = "doc_id long, stage string, raw string, error string"


def test_odd_documents_keep_their_rows(spark):
    docs = spark.createDataFrame([
        (1, None, "it"), (2, "", "it"), (3, "Mario Rossi scrive a m.rossi@example.com", None), (4, "x " * 30000 + "a@b.it", "xx"),
        (5, "solo testo", "it"), (6, "Mario Rossi", "it"), (None, "a@b.it", "it")], "doc_id long, content string, language string").withColumn("status2", F.lit("own"))
    ent = '{"entities": [{"value": "Mario Rossi", "category": "persone_fisiche", "entity_type": "nome_cognome"}, {"value": null, "category": "persone_fisiche"}]}'
    model = spark.createDataFrame([
        (1, "entities", "{}", None), (2, "entities", "", None), (3, "entities", ent, None), (3, "roles", '{"assignments": [{"value": "Mario Rossi", "role": "A"}, {"value": "Mario Rossi", "role": "B c"}]}', None),
        (4, "entities", "no json", None), (6, "entities", None, "TimeoutError"), (6, "roles", "{}", None), (9, "entities", ent, None), (3, "other", "x", None)], MODEL)
    got = {r.doc_id: r for r in EX.extract(docs, model).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    assert [got[i].status for i in (1, 2, 3, 4, 5, 6, None)] == ["success"] * 4 + ["error"] * 3
    assert (got[5].error, got[6].error, got[6].extracted) == (EX.NO_MODEL_OUTPUT, "TimeoutError", None)
    assert got[1].extracted == [] == got[2].extracted and "a@b.it" in [e.value for e in got[4].extracted]
    by = {e.value: e for e in got[3].extracted}
    assert by["Mario Rossi"].semantic_role == "b_c" and by["m.rossi@example.com"].semantic_role == "b_c"
    assert by["Mario Rossi"].proposed_replacement.startswith("[B_C_") and got[3].status2 == "own"
    rec = {r.document_id: r for r in EX.run_records(EX.extract(docs, model), "r", "t", "m", F.col("doc_id").cast("string")).collect()}
    assert rec["6"].extraction is None and rec["6"].anonymization is None and rec["6"].error == "TimeoutError"
    assert rec["3"].extraction.entities_count == len(got[3].extracted) >= 2
    assert "m.rossi@example.com" not in rec["3"].anonymization.anonymized_preview and len(rec["4"].anonymization.anonymized_preview) == 600
    none = docs.where("1 = 0")
    assert EX.extract(none, model).count() == 0 and EX.extract(docs, model.where("1 = 0")).where("status = 'error'").count() == 7


def test_run_records_have_the_files_layout(spark):
    from sparkredact.sources import io as IO
    docs = spark.createDataFrame([(1, "a@b.it")], "doc_id long, content string")
    model = spark.createDataFrame([(1, "entities", "{}", None)], MODEL)
    rec = EX.run_records(EX.extract(docs, model), "r", "t", "m", F.lit("d"))
    simple = lambda t: t.simpleString()
    assert [(f.name, simple(f.dataType)) for f in rec.schema] == [(f.name, simple(f.dataType)) for f in IO.RUN_RECORD_SCHEMA]


def test_a_run_yields_one_metric_row_a_stage(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "de")], "doc_id long, content string")

    def write(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    stages = [("one", lambda d: d.where("content is not null")), ("two", lambda d: d.select("doc_id"))]
    rows, metrics = EX.timed_stages(stages, docs, "r1", write)
    got = [tuple(r)[:4] for r in metrics.collect()]
    assert got == [("r1", "one", 2, 5), ("r1", "two", 2, 0)] and rows.count() == 2
    assert all(r.elapsed_ms >= 0 for r in metrics.collect())


def test_isolated_substitution_never_reads_a_placeholder(spark):
    ents = [(1, "PERSONA", "persone_fisiche", "nome_cognome", None), (2, "Mario Rossi", "persone_fisiche", "nome_cognome", None)]
    df = spark.createDataFrame([(ents, "Mario Rossi e PERSONA", "it")],
                               "e array<struct<seq:int,value:string,category:string,entity_type:string,semantic_role:string>>, content string, language string")
    one = X.anonymize_packed(df, "e", isolate=True).first().anonymized
    assert one == "[PERSONA_1] e [PERSONA_2]"
    assert X.anonymize_packed(df, "e").first().anonymized != one


@pytest.mark.parametrize("n", [1, 7, 40])
def test_running_numbers(spark, n):
    rng = random.Random(n)
    labels = [rng.choice("abc") for _ in range(n)]
    df = spark.createDataFrame([(labels,)], "x array<string>")
    assert list(df.select(X.running_numbers(F.col("x")).alias("n")).first().n) == [labels[:i + 1].count(x) for i, x in enumerate(labels)]


def test_ownership_prompts_run_the_role_passes_once(spark):
    plan = catalog.ownership_prompts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(vocab.DOC_TYPE_PATTERNS[0][1]) == 1      # the document type is part of the passes
