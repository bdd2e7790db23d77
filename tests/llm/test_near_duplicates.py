import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkredact.llm import jaccard_join, pivot_index
from sparkredact.llm.components import components
from tests.llm.fixtures import documents, empty, odd_texts, with_clashes, words


def roots(nodes, pairs):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2), (None, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if None not in e}
    assert found == roots(nodes, [e for e in edges if None not in e])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in roots(ids, pairs).items()}


def test_bounds_hold_for_all_small_sizes():
    for n in range(1, 40):
        for m in range(n, 60):
            c = next((c for c in range(n + 1) if 100 * c >= 75 * (n + m - c)), None)
            if c is None:
                continue
            assert jaccard_join.need(n, m) == c
            assert n - jaccard_join.index_length(n) + 1 <= c and m - jaccard_join.probe_length(m) + 1 <= c
            assert 4 * n >= 3 * m
    rng = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        y = np.unique(np.concatenate([y, x[: rng.integers(0, len(x) + 1)]]))
        assert jaccard_join.most_shared(len(x), jaccard_join.sketch(x), len(y), jaccard_join.sketch(y)) >= len(np.intersect1d(x, y))


def test_join_is_brute_force(spark):
    rng = random.Random(5)
    texts = odd_texts()
    passage = words(rng, 40)
    for _ in range(6):  # a passage that many share; edits of every size; very small sets with ties
        texts.append(words(rng, 30) + " " + passage)
        t = words(rng, rng.randrange(5, 90)).split()
        for k in (1, 2, 4, 9):
            texts.append(" ".join("edit%d" % k if rng.random() < k / 60 else x for x in t))
        texts.append(words(rng, rng.randrange(1, 9), 3))
    docs = with_clashes(documents(spark, texts))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert found == brute(list(enumerate(texts)))
    kept = jaccard_join.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in found.items() if c == i)


def test_light_sets_meet_heavy_ones_despite_a_frequent_phrase(spark):
    rng = random.Random(11)
    phrase, texts = words(rng, 10), []
    for i in range(48):  # 10 to 12 shingles, six of them of the phrase, and the same text with one to four words more
        t = words(rng, 4 + i % 3, 100_000) + " " + phrase
        texts += [t, t + " " + words(rng, 1 + i % 4, 100_000)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(documents(spark, texts)).collect()}
    assert {n for n, _ in found.values()} >= set(range(10, 16))
    assert found == brute(list(enumerate(texts)))


def test_join_of_null_ids_repeats_and_nothing(spark):
    docs = documents(spark, ["a b c d e f g"] * 3 + ["p q r s t u v"])
    null = docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.unionAll(null).unionAll(docs.where("doc_id = 3"))
    found = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in jaccard_join.join(rows).collect())
    assert found == [(False, 0, 0), (False, 1, 0), (False, 2, 0), (False, 3, 3), (False, 3, 3), (True, 0, None)]
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard_join.one_per_group(rows).collect())
    assert kept == [(False, 0), (False, 3), (True, 0)]
    assert jaccard_join.join(empty(docs)).count() == 0


def vectors(seed=1, n=150, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[:30] + rng.normal(size=(30, dim)) * 0.15
    crowd = base[0] + rng.normal(size=(60, dim)) * 0.2
    return [list(map(float, v.astype(np.float32))) for v in np.concatenate([base, near, crowd, base[:5], base[:5] * 3])]


def test_vectors_are_brute_force(spark):
    rows = [(i, v, i % 2) for i, v in enumerate(vectors())]
    n = len(rows)
    odd = [None, [], [0.0] * 24, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 20, rows[0][1], None), (n + 21, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as cid", "1 as n_links")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_index.near_duplicates(df, block=16).collect()}
    def usable(v, l):
        return l is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
    pairs = []
    for i, v, l in rows:
        for j, u, k in rows:
            if i < j and l == k and usable(v, l) and usable(u, k) and len(u) == len(v):
                x, y = np.array(v), np.array(u)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    pairs.append((i, j))
    least = roots([r[0] for r in rows], pairs)
    assert len(pairs) > 300
    wrong = 0
    for i, _, _ in rows:
        links = sum(i in p for p in pairs)
        assert found[i][0] <= links and found[i][2] == (found[i][1] == i)
        wrong += links - found[i][0]
    assert wrong <= 0.02 * 2 * len(pairs)  # an index: recall against brute force
    assert sum(found[i][1] == least[i] for i in least) >= 0.98 * len(least)
    assert pivot_index.near_duplicates(df.where("1 = 0")).count() == 0
