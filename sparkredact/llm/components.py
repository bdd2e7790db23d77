"""Connected components of an edge table by large-star and small-star steps.

Every step is joins and aggregates over the edges; nothing is collected but two
numbers a round.  A node with very many edges is one key of a join, which
adaptive execution splits, and one group of a pre-aggregated minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkredact.llm.common import write_table


def _star(links: DataFrame, keep) -> DataFrame:
    """``links`` (u, v): join each u with the least of its neighbours and itself, keep some."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return keep(links.join(least, "u"))


def _rows(df: DataFrame):
    """Number and order-free digest of the edges, to see that a round changed nothing."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) to ``node, component``: the least node reachable.

    Nodes without an edge don't appear; self-loops and repeated edges are
    harmless; edges with a null end are dropped; no edges give no rows.
    """
    now = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        if (state := _rows(now)) == seen or not state[0]:
            break
        seen = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, lambda x: x.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        # After it every edge points from the larger to the smaller node.
        small = _star(large, lambda x: x.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionAll(x.select("u", F.col("m").alias("v")))).where("u <> v").distinct()
        now = write_table(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
