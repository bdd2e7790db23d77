"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest pivots in order.  Inverted lists, one per
label and pivot, hold the vectors that name the pivot; two vectors that share at
least ``shared`` pivots are compared by cosine in double precision.  Equal
vectors are one class with a count.  A list longer than a block is dealt into
pairs of blocks, so a hot pivot is many tasks; each returns, per vector, the
number of its links and the least vector it is joined to, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkredact.llm.common import write_table
from sparkredact.llm.components import components

# Classes the pivots are drawn from, at most.
PIVOT_SAMPLE = 8192
PIVOTS = (64, 1024)
# Pivots lie apart: a crowd of near copies gives one.
PIVOT_COSINE = 0.7


def unit(rows: pa.Array) -> np.ndarray:
    """Rows of one dimension as unit vectors in double precision."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(rows), -1)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid(vector, label):
    """Rows that may link: label and components known and finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _pivots(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Per dimension, pivots that lie apart, from a bounded sample by hash order."""
    want = int(np.clip(2 ** round(np.log2(max(n, 1)) / 2), *PIVOTS))
    sample = classes.orderBy(F.xxhash64("vector"), "vector").limit(PIVOT_SAMPLE).select("vector").toArrow()["vector"]
    found: dict[int, np.ndarray] = {}
    by_size: dict[int, list] = {}
    for v in sample.to_pylist():
        by_size.setdefault(len(v), []).append(v)
    for size, rows in by_size.items():
        x = unit(pa.array(rows, pa.list_(pa.float64())))
        kept, nearest = [], np.full(len(x), -1.0)
        for i in range(len(x)):
            if len(kept) == want:
                break
            if nearest[i] < PIVOT_COSINE:
                kept.append(i)
                nearest = np.maximum(nearest, x @ x[i])
        found[size] = x[kept]
    return found


def _least_reached(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per node of 0..n-1 the least node it reaches over the pairs (x, y)."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, x, least[y])
        np.minimum.at(new, y, least[x])
        new = np.minimum(new, new[new])
        if (new == least).all():
            return least
        least = new


def near_duplicates(rows: DataFrame, threshold: float = 0.93, order: int = 8, shared: int = 2, block: int = 1024,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``order`` nearest pivots describe a vector, of which ``shared`` must agree
    (both count less where fewer pivots exist).  Vectors link only under equal
    labels and dimensions; null labels, null, zero, empty or non-finite vectors
    link with nothing.  A vector's own copies count as links, and repeated rows
    are copies.  A null vec_id takes part and is never the least.
    """
    rows = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].alias("vector"), rows[label_col].alias("label"))
    able = rows.where(valid(F.col("vector"), F.col("label")))
    classes = able.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = write_table(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    pivots = rows.sparkSession.sparkContext.broadcast(_pivots(classes, n))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                own = pivots.value.get(int(size))
                near = np.zeros((len(part), 1), np.int32)  # a dimension the sample missed: one list
                if own is not None:
                    near = np.argsort(-(unit(part.column("vector")) @ own.T), axis=1, kind="stable")[:, :order].astype(np.int32)
                yield part.append_column("near", pa.array(list(near), pa.list_(pa.int32())))

    near = (classes.select("cid", "label", F.size("vector").alias("dim"), "vector", "copies")
            .mapInArrow(describe, f"cid long, label {classes.schema['label'].dataType.simpleString()}, dim int, "
                                  f"vector {classes.schema['vector'].dataType.simpleString()}, copies long, near array<int>"))
    near = write_table(near, "pivot-orders")
    key = ["label", "dim", "pivot"]
    lists = near.select("cid", "label", "dim", F.explode("near").alias("pivot"))
    blocks = lists.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 0")
    entries = (near.withColumn("pivot", F.explode("near")).join(blocks, key)
               .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("cid")
        x, pivot = unit(group["vector"].combine_chunks()), group["pivot"][0].as_py()
        near = np.array(group["near"].to_pylist())
        own, lo, hi = group["own"].to_numpy(), group["lo"][0].as_py(), group["hi"][0].as_py()
        # Which pivots each names; a pair belongs to the first list the two share.
        names, at = np.unique(near, return_inverse=True)
        holds = np.zeros((len(x), len(names)), np.float32)
        holds[np.arange(len(x))[:, None], at.reshape(near.shape)] = 1
        one, two = (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
        agree = holds[one] @ holds[two].T >= min(shared, near.shape[1])
        agree &= holds[one][:, names < pivot] @ holds[two][:, names < pivot].T == 0
        if lo == hi:
            agree = np.triu(agree, 1)
        a, b = np.nonzero(agree)
        a, b = one[a], two[b]
        same = np.concatenate([(x[a[i:i + 65536]] * x[b[i:i + 65536]]).sum(axis=1) >= threshold
                               for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[same], b[same]
        copies = group["copies"].to_numpy()
        links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        cids = group["cid"].to_numpy()
        linked = np.flatnonzero(links)
        return pa.table({"cid": cids[linked], "root": cids[_least_reached(len(x), a, b)[linked]], "links": links[linked].astype(np.int64)})

    found = write_table(entries.groupBy(*key, "lo", "hi").applyInArrow(compare, "cid long, root long, links long"), "vector-links")
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = (classes.select("cid", "label", "vector", "copies", "least_id")
              .join(counts, "cid", "left").join(joined, F.col("cid") == F.col("node"), "left")
              .withColumn("root", F.coalesce("component", "cid")))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("label", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # An all-null key joins nothing, so rows that may not link keep the defaults.
    usable = valid(F.col("vector"), F.col("label"))
    out = rows.withColumn("key_label", F.when(usable, F.col("label"))).withColumn("key_vector", F.when(usable, F.col("vector")))
    named = named.withColumnsRenamed({"label": "key_label", "vector": "key_vector"})
    component = F.coalesce("component_id", "vec_id")
    return out.join(named, ["key_label", "key_vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
