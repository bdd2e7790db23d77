import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkredact.llm import toxicity
from tests.llm.fixtures import documents, empty, odd_texts, with_clashes, words


def corpus(spark, n=240):
    rng = random.Random(9)
    texts, toxic = [], []
    for i in range(n):
        t = words(rng, rng.randrange(15, 80)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["grobian", "schurke", "lump", "strolch"]))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(None, 1, 1), (5, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, toxic


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 0, 1, 5])
    e, trans, start = rng.normal(size=9), rng.normal(size=(2, 2)), 0.3
    got = toxicity.Chain(sizes).marginals(e, trans, start)[0]
    want, at = [], 0
    for n in sizes:
        total, hit = 0.0, np.zeros(n)
        for path in range(1 << n):
            s = [path >> k & 1 for k in range(n)]
            score = sum(e[at + k] for k in range(n) if s[k]) + sum(trans[s[k - 1], s[k]] for k in range(1, n)) + (start if n and s[0] else 0)
            total += np.exp(score)
            hit += np.exp(score) * np.array(s)
        want.extend(hit / total if n else [])
        at += n
    assert np.allclose(got, want)


def test_held_out_documents_and_spans(spark):
    docs, labels, toxic = corpus(spark)
    model = toxicity.train(with_clashes(docs), labels)
    found = toxicity.score(with_clashes(docs), model).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [r for r in found if r.held_out]
    assert len(held) > 50 and all((r.score >= 0.7) == bool(toxic[r.doc_id]) for r in held)
    spans = [texts[r.doc_id][s.start:s.end] for r in found for s in r.spans]
    assert spans and all(set(s.split()) <= {"grobian", "schurke", "lump", "strolch"} for s in spans)
    kept = toxicity.keep_clean(with_clashes(docs), model)
    assert kept.columns == with_clashes(docs).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.score < 0.7}


def test_odd_texts_and_missing_labels(spark):
    docs, labels, _ = corpus(spark)
    model = toxicity.train(docs, labels)
    odd = documents(spark, odd_texts())
    rows = toxicity.score(odd.unionAll(odd.where("doc_id = 5")), model).collect()
    assert len(rows) == len(odd_texts()) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    for none in (labels.where("1 = 0"), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert toxicity.score(empty(docs), toxicity.train(empty(docs), labels)).count() == 0


def test_long_labelled_texts_null_ids_and_missing_documents(spark):
    """Labels of texts that aren't given, or are too long to fit on, leave the sample full of those that are."""
    docs, labels, toxic = corpus(spark)
    # Most labels are of documents that are not here, most labelled texts too long.
    far = spark.createDataFrame([(i, 1, 1) for i in range(20_000, 23_000)], labels.schema)
    some = docs.where("doc_id is null or doc_id < 400")
    model = toxicity.train(some, labels.unionAll(far), toxic_rows=20, clean_rows=40)
    assert model.constant is None
    held = {r.doc_id: r.score for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    right = sum((s >= 0.7) == bool(toxic[d]) for d, s in held.items())
    assert right >= 0.95 * len(held)
    nameless = docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")
    assert toxicity.train(nameless, labels).constant == 0.0 and toxicity.score(nameless, model).count() == docs.count()


def test_associations_need_more_than_chance():
    seen = np.zeros((2, toxicity.BUCKETS), np.int64)
    seen[:, 1], seen[:, 2], seen[:, 3] = (0, 30), (90, 30), (0, 1)  # toxic texts alone, as all texts, too few to tell
    marked = toxicity.associations(seen, 0.25)
    assert marked[1] and not marked[2] and not marked[3] and marked.sum() == 1


def test_blocks_do_not_change_the_fit(monkeypatch):
    rng = random.Random(2)
    toxic = np.arange(60) % 3 == 0
    texts = [words(rng, 30) + (" schurke" if t else "") for t in toxic]
    whole = toxicity.fit(iter(texts), toxic, np.ones(60))
    monkeypatch.setattr(toxicity, "_BLOCK", 70)
    parts = toxicity.fit(iter(texts), toxic, np.ones(60))
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.document, parts.document, atol=1e-3)
