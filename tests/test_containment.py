"""The anchored containment join equals the brute-force substring join."""

import random

from sparkredact.operators.containment import contains_pairs


def test_contains_pairs_matches_brute_force(spark):
    rnd = random.Random(7)
    alpha = "abc"

    def word():
        return "".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 7)))

    left = [(d, i, word()) for d in range(5) for i in range(12)]
    right = [(d, j, word()) for d in range(5) for j in range(12)]
    L = spark.createDataFrame(left, "doc_id long, li int, lv string")
    R = spark.createDataFrame(right, "doc_id long, rj int, rv string")
    got = {(r.doc_id, r.li, r.rj) for r in contains_pairs(L, R, ["doc_id"], "lv", "rv").collect()}
    want = {(d, i, j) for d, i, lv in left for d2, j, rv in right if d == d2 and rv in lv}
    assert got == want
