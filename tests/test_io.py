import json

from pyspark.sql import functions as F

from sparkredact.operators import evaluate as EV
from sparkredact.operators.merge import legal_context_hit, occurrences
from sparkredact.sources import io as IO


def record(document, run_id, status="success", entities=()):
    return {"run_id": run_id, "document": document, "document_id": document, "status": status,
            "extraction": {"entities_count": len(entities), "entities": list(entities)}}


def test_latest_run_is_told_by_its_summary(spark, tmp_path):
    for run in ("20250101T000000Z", "20250102T000000Z"):
        for d in ("a.md", "b.md"):
            (tmp_path / f"{run}_{d[0]}.json").write_text(json.dumps(record(d, f"{run}-{d}")))
        (tmp_path / f"{run}_SUMMARY.json").write_text(json.dumps({"total_documents": 2}))
    (tmp_path / "20250103T000000Z_a.json").write_text(json.dumps(record("a.md", "unfinished")))
    assert IO.latest_run(spark, str(tmp_path)) == "20250102T000000Z"
    rows = IO.read_run_records(spark, str(tmp_path)).collect()
    assert sorted(r.run_id for r in rows) == ["20250102T000000Z-a.md", "20250102T000000Z-b.md"]
    assert IO.read_run_records(spark, str(tmp_path), "20250103T000000Z").count() == 1


def test_no_summary_no_run(spark, tmp_path):
    (tmp_path / "20250103T000000Z_a.json").write_text(json.dumps(record("a.md", "x")))
    assert IO.latest_run(spark, str(tmp_path)) is None
    assert IO.read_run_records(spark, str(tmp_path)).count() == 0


def test_empty_annotation_counts_false_positives_and_failed_runs_leave_both_sides(spark, tmp_path):
    item = {"value": "Anna Rossi", "category": "persone_fisiche", "entity_type": "nome_cognome"}
    (tmp_path / "empty.json").write_text(json.dumps({"document": "empty", "entities": []}))
    (tmp_path / "failed.json").write_text(json.dumps({"document": "failed", "entities": [item]}))
    truth = IO.read_ground_truth(spark, str(tmp_path)).withColumnRenamed("document", "doc_id")
    pred = spark.createDataFrame([("empty", "X", "persone_fisiche"), ("none", "Y", "persone_fisiche")], "doc_id string, value string, category string")
    runs = spark.createDataFrame([("empty", "success"), ("failed", "error"), ("none", "success")], "doc_id string, status string")
    p, t = EV.evaluable(pred, truth, runs)
    assert [(r.doc_id, r.tp, r.fp, r.fn) for r in EV.strict_counts(p, t).collect()] == [("empty", 0, 1, 0)]
    gone = EV.skipped(runs.select("doc_id"), truth, runs).collect()
    assert {(r.doc_id, r.reason) for r in gone} == {("failed", "run failed"), ("none", "no annotation")}


def test_redacted_texts_keep_their_boundaries(spark, tmp_path):
    df = spark.createDataFrame([(1, "one\ntwo"), (2, "three")], "doc_id long, anonymized string")
    IO.write_redacted_text(df, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).collect()
    assert {(r.doc_id, r.anonymized) for r in back} == {(1, "one\ntwo"), (2, "three")}


def test_overlapping_occurrences_have_their_own_window(spark):
    text = "anana" + " " * 199 + "sede legale"
    df = spark.createDataFrame([(text, "ana"), ("aaaa", "aa"), ("abc", ""), ("abcabc", "bc")], "t string, v string")
    at = [r[0] for r in df.select(occurrences(F.col("t"), F.col("v"))).collect()]
    assert at == [[1, 3], [1, 2, 3], [], [2, 5]]
    assert df.limit(1).select(legal_context_hit(F.col("t"), F.col("v"))).first()[0]
