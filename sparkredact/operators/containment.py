"""Exact substring-containment join without examining all pairs of a group.

``contains_pairs(left, right, keys, lcol, rcol)`` returns the pairs of rows
that agree on ``keys`` and whose ``rcol`` value is a substring of ``lcol``.
Instead of comparing every left row with every right row of a key group,
each right value is joined on an *anchor*:

* right values of length >= K join on their first K characters against the
  distinct K-grams of the left value;
* the rare shorter right values (1 .. K-1 characters) join on the keys alone.

Any occurrence of r inside l starts with r's anchor at some position of l,
so the candidate set is complete; ``instr`` then confirms each candidate.
The join key is (keys, anchor): a document with many entities spreads over
many anchors instead of one hot group.  Empty right values never join
(callers drop them; detectors and parsers never emit them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 3


def _grams(v: Column, m: int) -> Column:
    """Distinct substrings of length ``m`` of ``v`` (empty when shorter)."""
    n = F.length(v) - m + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                                       lambda i: F.substring(v, i, m)))) \
            .otherwise(F.array().cast("array<string>"))


def contains_pairs(left: DataFrame, right: DataFrame, keys: list[str], lcol: str, rcol: str) -> DataFrame:
    """Pairs (left row, right row) with equal ``keys`` and ``rcol`` in ``lcol``.
    Column names of the two sides must be disjoint except for ``keys``."""
    l_long = left.select("*", F.explode(_grams(F.col(lcol), K)).alias("_anchor"))
    r_long = right.where(F.length(rcol) >= K).withColumn("_anchor", F.substring(rcol, 1, K))
    long_pairs = l_long.join(r_long, keys + ["_anchor"]).drop("_anchor")
    # right values shorter than K (1-2 characters) are rare; they join on the
    # keys alone instead of exploding every left value's short substrings
    r_short = right.where((F.length(rcol) >= 1) & (F.length(rcol) < K))
    short_pairs = left.join(r_short, keys)
    return long_pairs.unionByName(short_pairs).where(F.instr(F.col(lcol), F.col(rcol)) > 0)
