import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkredact.llm import importance_resampling as ir
from tests.llm.fixtures import documents, empty, odd_texts, with_clashes, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feats(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return len(ws), ws + [a + " " + b for a, b in zip(ws, ws[1:])]


def brute(rows, target, percent=25, least=20):
    """rows of (doc_id, text) to sorted (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, feats(text)[1]))
    for text in target:
        t.update(map(bucket, feats(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for doc, text in rows:
        n, f = feats(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None, n])
    able = sorted((o for o in out if o[3] is not None and o[5] >= least), key=lambda o: (-o[3], o[0]))
    for i, o in enumerate(able[:percent * len(able) // 100]):
        o[4] = i + 1
    return sorted((tuple(o[:5]) for o in out), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    texts = odd_texts() + [words(rng, rng.randrange(10, 60)).title() for _ in range(300)] + ["d1Gits 22 É_x-y z " * 9]
    docs = documents(spark, texts)
    target = spark.createDataFrame([(0, words(rng, 300, 40)), (1, None), (2, "")], "item_id long, text string")
    got = ir.resample(with_clashes(docs), target).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got), key=str) == brute(
        list(enumerate(texts)), [r.text for r in target.collect()])


def test_repeats_missing_ids_and_empty_tables(spark):
    rng = random.Random(12)
    rows = [(i % 40, words(random.Random(i % 40), 30)) for i in range(200)] + [(None, words(rng, 50)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(words(rng, 200),)], "text string")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in ir.resample(docs, target).collect()), key=str)
    assert got == brute(rows, [target.first().text])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 51))
    assert ir.resample(empty(docs), target).count() == 0
    assert ir.resample(docs, empty(target)).where("rank is not null").count() == 50
    few = ir.resample(docs, target, percent=0)
    assert few.where("rank is null").count() == 202


@pytest.mark.parametrize("chunk, finish", [(16, 1), (1000, 8), (64, 4096)])
def test_cutoff_is_exact(spark, chunk, finish):
    rng = np.random.default_rng(3)
    a = rng.integers(-20, 20, 700)
    a[:250] = 5  # a third share one key part, and whole keys repeat
    b = np.where(np.arange(700) < 120, 7, rng.integers(0, 50, 700))
    keys = sorted(zip(a.tolist(), b.tolist()))
    table = spark.createDataFrame(keys, "a long, b long").repartition(5)
    for k in (1, 2, 175, 350, 420, 699, 700):
        assert ir.cutoff(table, k, chunk, finish) == keys[k - 1]


def test_rounds_shrink_what_is_left(spark):
    table = spark.range(4000).select(F.xxhash64("id").alias("a"), F.col("id").alias("b"))
    keys = sorted((r.a, r.b) for r in table.collect())
    assert ir.cutoff(table, 1000, chunk=32, finish=1) == keys[999]
