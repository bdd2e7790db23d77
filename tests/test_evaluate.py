"""Evaluation: strict and lenient counts, normal form, report zero-fill."""

from pyspark.sql import functions as F

from sparkredact.operators import evaluate as EV

S = "doc_id long, value string, category string"


def test_strict_tp_plus_fn_is_distinct_truth_and_wrong_category_counts_twice(spark):
    truth = spark.createDataFrame([(1, "Mario Rossi", "persone_fisiche"), (1, " mario  rossi.", "persone_fisiche"),
                                   (1, "a@b.it", "dati_contatto"), (1, "Acme", "persone_giuridiche")], S)
    pred = spark.createDataFrame([(1, "MARIO ROSSI", "persone_fisiche"), (1, "Acme", "persone_fisiche"),
                                  (1, "x@y.it", "dati_contatto")], S)
    c = {r.category: (r.tp, r.fp, r.fn) for r in EV.strict_counts(pred, truth).collect()}
    assert c == {"persone_fisiche": (1, 1, 0), "dati_contatto": (0, 1, 1), "persone_giuridiche": (0, 0, 1)}
    distinct_truth = 3     # "Mario Rossi" twice normalises to one value
    assert sum(tp + fn for tp, _, fn in c.values()) == distinct_truth
    l = {r.category: (r.tp, r.fp, r.fn) for r in EV.lenient_counts(pred, truth).collect()}
    assert l["persone_fisiche"] == (2, 0, 0)          # Acme counts: the value is annotated
    assert l.get("persone_giuridiche", (0, 0, 0)) == (0, 0, 0)   # Acme was predicted (other category)


def test_lenient_counts_of_null_keys_stay_apart_and_each_side_is_read_once(spark):
    truth = spark.createDataFrame([(1, "Acme", "a"), (1, "Lumen", None), (1, "Lumen", "a"), (1, None, "b"), (None, "Acme", "a"), (2, "only here", "b")], S)
    pred = spark.createDataFrame([(1, "ACME", None), (1, "acme.", None), (1, "Vertex", None), (1, "Vertex", "a"), (None, "Acme", "a"), (3, "new", "b")], S)
    counts = EV.lenient_counts(pred, truth)
    assert counts.columns == ["doc_id", "category", "tp", "fp", "fn"]
    want = [(1, None, 1, 1, 0), (1, None, 0, 0, 1), (1, "a", 0, 1, 1), (None, "a", 0, 1, 0), (None, "a", 0, 0, 1), (2, "b", 0, 0, 1), (3, "b", 0, 1, 0)]
    assert sorted(map(str, map(tuple, counts.collect()))) == sorted(map(str, want))
    inputs = [leaf for leaf in counts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LogicalRDD" in leaf]
    assert len(inputs) == 2


def test_report_zero_fill_and_undefined_ratios(spark):
    counts = spark.createDataFrame([(1, "dati_contatto", 0, 0, 2)], "doc_id long, category string, tp long, fp long, fn long")
    lang = spark.createDataFrame([(1, "IT")], "doc_id long, lang string")
    rep = {(r.grouping, r.grp): (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1)
           for r in EV.report(spark, counts, lang).collect()}
    assert rep[("category", "persone_fisiche")] == (0, 0, 0, 0.0, 0.0, 0.0)
    assert rep[("total", "all")] == (0, 0, 2, 0.0, 0.0, 0.0)
    assert len([k for k in rep if k[0] == "category"]) == 6


def test_language_from_file_name(spark):
    df = spark.createDataFrame([("01_CV_IT.md",), ("09_Clinic_DECH.md",), ("x_DE.md",), ("plain.md",)], "f string")
    assert [r.l for r in df.select(EV.language_from_name(F.col("f")).alias("l")).collect()] == ["IT", "DE", "DE", "??"]
