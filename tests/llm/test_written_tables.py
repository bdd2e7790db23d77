import glob
import tempfile
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")

from sparkredact.llm import line_templates  # noqa: E402
from sparkredact.llm.common import write_table  # noqa: E402


def shuffle_files(spark):
    top = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    return set(glob.glob(f"{top}/**/blockmgr-*/*/shuffle_*", recursive=True))


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    def rows():
        return spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))

    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = shuffle_files(spark), spark.conf.get(conf)
    plain = rows()
    plain.write.parquet(str(tmp_path / "plain"))
    seen = shuffle_files(spark)
    assert seen - before  # so the files are looked for where they are
    out = write_table(rows(), "rows")
    for _ in range(50):
        if not (left := shuffle_files(spark) - seen):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(conf) == set_to
    assert sorted(out.collect()) == sorted(plain.collect())


def test_texts_are_masked_once_a_pass(spark):
    texts = spark.createDataFrame([(1, "one 1 two 2\tthree\n\n  a b  c d e  \na b c d e")], "_doc long, _text string")
    entries = line_templates._entries(texts, 3, 5)
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2  # digits, and runs of blanks
    masks = [r.x for line in ("one # two # three", "a b c d e") for r in spark.range(1).select(F.xxhash64(F.lit(line)).alias("x")).collect()]
    assert sorted(r.mask for r in entries.collect()) == sorted(masks)
