import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = {r.doc_id: r for r in docs.collect()}
    seen = []
    rows = docs
    from sparkredact.llm.common import write_table

    for name, stage in pipeline.STAGES:
        rows = write_table(stage(spark, rows, SMALL), name)
        seen.append((name, rows.columns, rows.count()))
        if name != "packing":
            assert rows.columns == docs.columns
            assert {r.doc_id for r in rows.collect()} <= set(first)
    assert [s[0] for s in seen] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mix_sources", "packing"]
    assert seen[0][2] == seen[1][2] > seen[2][2]
    assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_llm_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
