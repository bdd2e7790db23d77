"""Members of a long list are compared by blocks that return few pairs and lose no link."""

import numpy as np

from sparkredact.llm import jaccard_join as J
from sparkredact.llm.components import components


def block(sets, component):
    sizes = np.array([len(s) for s in sets])
    return {"cls": np.arange(len(sets)) + 1000 * component, "n": sizes, "pos": np.zeros(len(sets), np.int64),
            "component": np.full(len(sets), component), "sketch": [J.sketch(s) for s in sets]}


def test_blocks_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.permutation(np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64)))

    def some(k):
        own = base[:rng.integers(20, 140)]
        return np.unique(np.concatenate([own[rng.random(len(own)) > 0.1], rng.integers(0, 1 << 64, rng.integers(1, 12), dtype=np.uint64)]))

    xs, ys = [some(k) for k in range(60)], [some(k) for k in range(50)]
    pairs = set(zip(*(p.tolist() for p in J.near_in_blocks(block(xs, 1), block(ys, 2)))))
    links = {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if len(np.intersect1d(x, y)) >= J.need(len(x), len(y))}
    assert len(links) > 20 and links <= pairs and len(pairs) < 3 * len(links) < len(xs) * len(ys) / 3
    assert not len(J.near_in_blocks(block(xs, 1), block(xs, 1))[0])         # one component is never compared
    assert not len(J.near_in_blocks(block([], 1), block(ys, 2))[0])


def texts():
    """40 texts of one passage, each with 70 other words at a place of its own: lists of all, no link."""
    words = [f"w{i}" for i in range(600)]
    return [" ".join([*words[:at], *(f"x{at}y{i}" for i in range(70)), *words[at + 70:]]) for at in range(13, 533, 13)]


def test_unlinked_texts_of_a_long_list_make_few_pairs(spark, monkeypatch):
    made, links = [], J._links

    def counted(pairs, docs, digests):
        made.append(pairs.count())
        return links(pairs, docs, digests)

    monkeypatch.setattr(J, "_links", counted)
    rows = [*enumerate(texts()), (90, texts()[3]), (91, texts()[3] + " more")]
    found = {r.doc_id: r.component_id for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: k for k in range(40)} | {90: 3, 91: 3}
    assert made[1] < 40


def test_lists_of_several_blocks_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "SHORT", 2)
    sets = [np.unique(np.random.default_rng(k // 2).integers(0, 1 << 64, 40, dtype=np.uint64)) for k in range(50)]
    entries = spark.createDataFrame([(5, k, len(s), 0, k, 50) for k, s in enumerate(sets)], "key long, cls long, n int, pos int, component long, length long")
    digests = spark.createDataFrame([(k, bytearray(J.sketch(s))) for k, s in enumerate(sets)], "rid long, sketch binary")
    pairs = J._long_list_pairs(entries, digests)
    assert sorted(map(tuple, pairs.collect())) == [(k, k + 1) for k in range(0, 50, 2)]
    assert components(pairs).count() == 50
