"""Texts are scored in blocks of a bounded number, and score alike in any block."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sparkredact.llm import toxicity


def test_blocks_are_small_and_change_no_score():
    bad, fine = ["you rotten idiot %d" % i for i in range(40)], ["a calm walk by the river %d" % i for i in range(40)]
    model = toxicity.fit(iter(bad + fine), np.array([True] * 40 + [False] * 40), np.ones(80))
    texts = [(bad if i % 3 == 0 else fine)[i % 40] for i in range(2300)] + [None, ""]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    parts = list(toxicity.blocks(batch))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts and max(map(len, parts)) <= 1000
    scored = lambda some: toxicity._scores(some, model, toxicity.Emissions(model), False)[0].tolist()
    assert [x for p in parts for x in scored(p.column(0).to_pylist())] == scored(texts)


def test_the_fit_leaves_nothing_but_its_model():
    texts = [" ".join(f"word{i}x{j}" for j in range(40)) + (" foul" if i % 2 else "") for i in range(500)]
    toxicity.fit(iter(texts[:4]), np.array([0, 1, 0, 1], bool), np.ones(4))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        model = toxicity.fit(iter(texts), np.array([i % 2 for i in range(500)], bool), np.ones(500), steps=2)
        kept = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    # The 20,000 distinct words and their features took 10 MB more in a memo.
    assert kept < model.weights.nbytes + 1_000_000
