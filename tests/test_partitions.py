"""The partitions that documents are worked on in grow with their number."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkredact.plans import catalog
from sparkredact.sources import derived as DV
from sparkredact.sources import tables as T


@pytest.fixture
def customers(spark, tmp_path):
    """60 customers, two orders for every third, and seven suppliers."""
    day = datetime.date(2020, 1, 1)
    rows = {"customer": ([(k, k % 25) for k in range(60)], "c_custkey long, c_nationkey int"),
            "orders": ([(k // 2, k // 2 - k // 2 % 3, day + datetime.timedelta(days=k)) for k in range(120)], "o_orderkey long, o_custkey long, o_orderdate date"),
            "supplier": ([(k,) for k in range(7)], "s_suppkey long")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_partitions_grow_with_the_documents(spark, customers, monkeypatch):
    assert DV.partitions(spark, customers) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(T, "DOCS_PER_TASK", 6)
    monkeypatch.setattr(DV, "LAID_OUT_PER_TASK", 10)
    assert DV.partitions(spark, customers) == 10
    few = sizes(DV.documents(spark, customers).select("doc_id"))       # laid out by several tasks
    assert sum(few) == 60 and len(few) > 4
    rows = catalog._assembled(spark, customers)
    assert sum(sizes(rows.select("doc_id"))) == 60 and rows.rdd.getNumPartitions() == 10
    assert catalog._ddocs(spark, customers).rdd.getNumPartitions() == 10
