"""Review decisions (batch and stream), default placeholders, write-back, lookups, reruns, sinks, model hook."""

import datetime as dt
import os
import random
import uuid

import pandas as pd
from pyspark.sql import functions as F

from sparkredact.operators import detect as D
from sparkredact.operators import evaluate as EV
from sparkredact.operators import governance as G
from sparkredact.operators import lookup as LK
from sparkredact.operators import model as MD
from sparkredact.operators import rerun as RR
from sparkredact.operators import review as RV
from sparkredact.sources import io as IO
from sparkredact.streaming import review_stream as RS

DEC = "doc_id long, seq int, action string, decided_at timestamp, event_id long"
ENTS = "doc_id long, ents array<struct<seq:int,value:string,category:string,entity_type:string,semantic_role:string>>"
T0 = dt.datetime(2024, 3, 1)


def decisions(seed, n=400, docs=6, seqs=5):
    rng = random.Random(seed)
    acts = ["accepted", "removed", "proposed", "accept_all", "remove_all"]
    out = []
    for i in range(n):
        action = rng.choices(acts, [5, 4, 3, 1, 1])[0]
        out.append((rng.randrange(docs), None if action.endswith("all") else rng.randrange(1, seqs + 1), action, T0 + dt.timedelta(minutes=rng.randrange(60 * 20)), i))
    return out


def replayed(rows, doc, seq):
    status = "proposed"
    for _, s, action, *_ in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[3], r[4])):
        if action == "remove_all":
            status = "removed"
        elif action == "accept_all":
            status = status if status == "removed" else "accepted"
        elif s == seq:
            status = action
    return status


def entity_docs(spark, docs=7, seqs=5):
    return spark.createDataFrame([(d, [(s, f"v{s}", "c", "t", None) for s in range(1, seqs + 1)]) for d in range(docs)] + [(99, [])], ENTS)


def test_statuses_equal_a_replay(spark):
    for seed in (1, 2, 3):
        rows = decisions(seed, 120)
        odd = [(None, 1, "accepted", T0, 900), (1, 2, "accepted", None, 901), (1, None, "accepted", T0, 902), (2, 1, "strange", T0 + dt.timedelta(days=9), 903), rows[5], rows[5]]
        got = RV.reviewed(entity_docs(spark), RV.decision_registers(spark.createDataFrame(rows + odd, DEC))).collect()
        assert {r.doc_id: list(r.statuses) for r in got} == {**{d: [replayed(rows, d, s) for s in range(1, 6)] for d in range(7)}, 99: []}
    assert RV.reviewed(entity_docs(spark), RV.decision_registers(spark.createDataFrame([], DEC))).where("exists(statuses, s -> s <> 'proposed')").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Late and repeated decisions, over several micro-batches."""
    rows = decisions(7)
    rng = random.Random(8)
    rows.sort(key=lambda r: r[3])
    mixed = sorted(rows, key=lambda r: r[3] + dt.timedelta(minutes=rng.randrange(600)))  # up to ten hours late
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [mixed[i::1][k * 80:(k + 1) * 80] for i in (0,) for k in range(5)]
    for k, part in enumerate(parts):
        again = rng.sample(mixed[:(k + 1) * 80], 20)
        spark.createDataFrame(part + again, DEC).coalesce(1).write.mode("append").parquet(source)
    query = RS.start(spark, source, sink, name=uuid.uuid4().hex, files=1)
    query.awaitTermination(300)
    assert query.exception() is None
    streamed = RS.registers(spark.read.parquet(sink))
    batch = RV.decision_registers(spark.createDataFrame(rows, DEC))
    one, two = ({r.doc_id: r.statuses for r in RV.reviewed(entity_docs(spark), x).collect()} for x in (streamed, batch))
    assert one == two and len(query.recentProgress) > 1


def test_merging_decisions_is_order_free():
    rows = [(s, a, int(t.timestamp()), e) for d, s, a, t, e in decisions(4, 60, 1)]
    rng = random.Random(0)
    once = RS.merge_decisions({}, RS._NEVER, RS._NEVER, rows)
    for _ in range(20):
        again = rows + rng.sample(rows, 10)
        rng.shuffle(again)
        assert RS.merge_decisions({}, RS._NEVER, RS._NEVER, again) == once


def test_default_placeholders_and_write_back(spark):
    ents = [(1, "a", "dati", "email", None), (2, "b", "dati", "email", "x"), (3, "c", "dati", "", None), (4, "d", "", None, None), (5, "a", "dati", "email", None)]
    df = spark.createDataFrame([(1, ents)], ENTS)
    shown = F.array(F.lit(None).cast("string"), F.lit("[EMAIL_9]"), F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert list(df.select(RV.default_placeholders(F.col("ents"), shown).alias("s")).first().s) == ["[EMAIL_1]", "[EMAIL_9]", "[DATI_1]", "[ENTITA_1]", "[EMAIL_2]"]
    maps = F.expr("array(named_struct('original', 'a', 'replacement', '[X]', 'semantic_role', cast(null as string)), "
                  "named_struct('original', 'b', 'replacement', '[Y]', 'semantic_role', 'r'), named_struct('original', 'a', 'replacement', '[Z]', 'semantic_role', ''))")
    out = df.select(RV.write_back(F.col("ents"), shown, maps).alias("r")).first().r
    assert [(r.original, r.substitution, r.semantic_role) for r in out] == [("a", "[Z]", None), ("b", "[Y]", "r"), ("c", "", None), ("d", None, None), ("a", "[Z]", None)]


def test_lookup_equals_brute_force(spark):
    rng = random.Random(5)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(0, 9 * 3600, 600))
    stored = [(rng.choice([1, 1, 1, 2, 3]), at()) for _ in range(60)] + [(None, T0), (4, None)]
    asked = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5, None]), at()) for i in range(200)] + [(900, 1, None), (7, 1, T0)]
    rows = LK.look_up(spark.createDataFrame(asked, "request_id long, doc_id long, at timestamp"), spark.createDataFrame(stored, "doc_id long, created_at timestamp"), ttl_seconds=3600)

    def one(doc, t):
        made = [c for d, c in stored if d == doc and doc is not None and c is not None and t is not None and c <= t]
        if not made:
            return (None, LK.NOT_FOUND)
        return (max(made), None) if t - max(made) <= dt.timedelta(hours=1) else (None, LK.EXPIRED)

    got = sorted(((r.request_id, r.doc_id, r.at, r.created_at, r.reason) for r in rows.collect()), key=str)
    assert got == sorted(((i, d, t, *one(d, t)) for i, d, t in asked), key=str)
    ok, errors = LK.split_errors(rows)
    assert ok.count() + errors.count() == len(asked) and {r.reason for r in errors.collect()} == {LK.NOT_FOUND, LK.EXPIRED}


def test_rerun_touches_changed_partitions_only(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [(d, s, f"r{s}", "cv", "cv") for d in range(60) for s in (1, 2)]
    RR.write_results(spark.createDataFrame(rows, "doc_id long, seq int, role string, document_type string, detected_type string"), path, 16)

    def files():
        return {os.path.join(r, p): os.stat(os.path.join(r, p)).st_mtime_ns for r, _, fs in os.walk(path) for p in fs if p.endswith(".parquet")}

    before = files()
    overrides = spark.createDataFrame([(3, "legal"), (4, "cv"), (5, "nonsense"), (6, None), (777, "legal")], "doc_id long, document_type string")

    def run(changed):
        return changed.select("doc_id", F.lit(1).alias("seq"), F.lit("new").alias("role"), F.col("override").alias("document_type"), F.lit("cv").alias("detected_type"))

    assert RR.rerun(spark, path, 16, overrides, run) == 1
    after, table = files(), spark.read.parquet(path)
    assert len(set(after) - set(before)) == 1 and len(set(before) - set(after)) == 1  # the changed document's partition
    got = {(r.doc_id, r.seq, r.role, r.document_type) for r in table.collect()}
    assert got == {(d, s, r, t) for d, s, r, t, _ in rows if d != 3} | {(3, 1, "new", "legal")}
    assert RR.rerun(spark, path, 16, overrides, run) == 0 and files() == after
    back = spark.createDataFrame([(3, None)], "doc_id long, document_type string")
    assert RR.changed_documents(table, back).count() == 1


def test_a_run_written_again_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "runs")
    report = spark.createDataFrame([("document", "b", 1), ("total", "all", 9), ("category", "dati_temporali", 2), ("document", "a", 3), ("category", "persone_fisiche", 4),
                                    ("language", "IT", 5)], "grouping string, grp string, tp long")
    ordered = EV.sorted_report(report)
    assert [r.grp for r in ordered.collect()] == ["a", "b", "IT", "persone_fisiche", "dati_temporali", "all"]
    IO.write_run(ordered, path, "r1")
    IO.write_run(ordered.withColumn("tp", F.lit(0)), path, "r2")
    IO.write_run(ordered.where("grouping = 'total'"), path, "r1")
    got = sorted((r.run_id, r.grp, r.tp) for r in spark.read.parquet(path).collect())
    assert [g for g in got if g[0] == "r1"] == [("r1", "all", 9)] and len([g for g in got if g[0] == "r2"]) == 6


def test_model_hook_sets_up_once_and_keeps_failures(spark):
    def make():
        asked = {"n": 0, "flaky": 0}

        def model(prompts):
            asked["n"] += 1
            if any("bad" in p for p in prompts):
                raise RuntimeError("secret text")
            if any("flaky" in p for p in prompts) and asked["flaky"] < 1:
                asked["flaky"] += 1
                raise TimeoutError
            return [p.upper() for p in prompts]
        return model

    prompts = spark.createDataFrame([(1, "one"), (2, "bad"), (3, None), (4, "flaky"), (5, "")], "doc_id long, prompt string").coalesce(1)
    got = {r.doc_id: r for r in MD.run_model(prompts, make, "entities", retries=2).collect()}
    assert (got[1].raw, got[1].error, got[5].raw) == ("ONE", None, "")
    assert (got[2].raw, got[2].error, got[2].attempts) == (None, "RuntimeError", 3)
    assert (got[3].raw, got[3].error, got[3].attempts) == (None, "no prompt", 0)
    assert (got[4].raw, got[4].error, got[4].attempts) == ("FLAKY", None, 3)
    assert MD.run_model(prompts.where("1 = 0"), make, "entities").count() == 0


def test_keep_fn_judges_distinct_values_once(spark):
    ents = spark.createDataFrame([(d, 1, v, "persone_fisiche", t, 0.5, "ner", lang) for d, v, t, lang in [
        (1, "Anna Bo", "nome_cognome", "it"), (2, "Anna Bo", "nome_cognome", "it"), (3, "Anna Bo", "nome_cognome", None), (4, "x", "email", "it"), (5, "Eva Li", "nome_cognome", "it")]],
        "doc_id long, seq int, value string, category string, entity_type string, confidence double, source string, language string")
    seen = spark.sparkContext.accumulator(0)

    def keep(values, types, langs):
        seen.add(len(values))
        return pd.Series([None if lang == "" else not v.startswith("Anna") for v, lang in zip(values, langs)])

    assert sorted(r.doc_id for r in D.keep_by(ents, keep).collect()) == [3, 4, 5] and seen.value == 3


def test_character_references(spark):
    cases = {"a &amp; b": "a & b", "&amp;lt;": "&lt;", "&#233;&#xE9;&eacute;": "ééé", "&#128512;": "\U0001f600", "&nope; &": "&nope; &", "&#0;&#55296;": "&#0;&#55296;",
             "x&nbsp;y": "x y", "&lt;b&gt;": "<b>", "": "", "&#160;z": "z"}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, html string")
    assert [r.t for r in df.orderBy("i").select(G.html_to_text(F.col("html")).alias("t")).collect()] == list(cases.values())
    assert df.select(G.html_to_text(F.lit(None).cast("string")).alias("t")).first().t is None


def test_nfkc_gets_other_than_ascii_alone(spark):
    df = spark.createDataFrame([(1, "ＡＢ ﬁ"), (2, " Ab\t c. "), (3, None)], "doc_id long, value string")
    form = df.select("doc_id", EV.normal_form(F.col("value")).alias("v"))
    assert {r.doc_id: r.v for r in form.collect()} == {1: "ab fi", 2: "ab c", 3: None}
    plan = form._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_nfkc(CASE WHEN") >= 1
