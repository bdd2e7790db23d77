import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from sparkredact.llm import spelling_trie as st
from tests.llm.fixtures import documents, empty, odd_texts, with_clashes

LETTERS = "abcdefnoé"


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def mutate(w, rng):
    i, c = rng.randrange(len(w)), rng.choice(LETTERS)
    return rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w[:i] + w[i + 1:i + 2] + w[i:i + 1] + w[i + 2:]])


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(7, 10))) for _ in range(n)]
    for _ in range(3 * n):
        out.append(mutate(rng.choice(out), rng))
    return sorted(set(out))


@pytest.mark.parametrize("block", [8, 100, 4096])
def test_near_pairs_equal_brute_force(spark, block):
    words = [w for w in vocabulary(120) if len(w) >= 5] + ["a" * 600, "a" * 599, "a" * 300 + "b" + "a" * 299, "n" * 600]
    want = {tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if distance_one(a, b)}
    rows = st.near_pairs(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long"), block).collect()
    assert len(rows) == len(want) > 100 and {tuple(sorted((r.a, r.b))) for r in rows} == want
    assert all(words[r.n_a] == r.a and words[r.n_b] == r.b for r in rows)


def test_verification_is_exact():
    rng = random.Random(8)
    words = vocabulary(40, 2)
    pairs = [(a, b) for a in words for b in words if len(b) - len(a) in (0, 1) and a != b]
    pairs = rng.sample(pairs, 4000) + [(a, b) for a, b in pairs if distance_one(a, b)]
    pairs += [("x" * n + a, "x" * n + b) for n in (30, 400) for a, b in pairs[:300] + pairs[-300:]]
    at = np.arange(len(pairs))
    got = st.one_apart(st._Words([a for a, _ in pairs]), at, st._Words([b for _, b in pairs]), at)
    assert got.tolist() == [distance_one(a, b) for a, b in pairs]


def test_search_meets_every_budgeted_leaf():
    rng = np.random.default_rng(4)
    leaves = np.unique(rng.integers(0, 3, (300, st.GROUPS)).astype(np.uint8), axis=0)
    leaves = np.array(sorted(map(bytes, np.concatenate([leaves, leaves + (rng.random(leaves.shape) < 0.05)]).astype(np.uint8))))
    leaves = np.array([np.frombuffer(x.ljust(st.GROUPS, b"\0"), np.uint8) for x in leaves])
    seen = set()

    def reached(lo, hi, who, surplus, deficit, depth):
        for i in range(lo, hi):
            for j, s, d in zip(who, surplus, deficit):
                moved = leaves[i, depth:].astype(int) - leaves[j, depth:]
                if s + moved.clip(0).sum() <= 1 and d + (-moved).clip(0).sum() <= 1:
                    seen.add((i, int(j)))

    st.search(leaves, leaves, reached, few=1)
    moved = leaves[:, None].astype(int) - leaves[None]
    want = np.argwhere((moved.clip(0).sum(2) <= 1) & ((-moved).clip(0).sum(2) <= 1))
    # A pair is met from one of its two sides at least, nothing else is.
    assert seen <= {tuple(x) for x in want.tolist()} and len(want) > len(leaves)
    assert {(i, j) for i, j in seen} | {(j, i) for i, j in seen} == {tuple(x) for x in want.tolist()}


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = crc32(f"{'' if doc is None else doc}:{run}".encode())
                counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if distance_one(v, w)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: f if f and words[f] >= 10 * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def test_variants_equal_brute_force(spark):
    rng = random.Random(6)
    words = vocabulary(25, 3)
    heavy = ["abcdefn", "abcdefna", "abcdefnab"]  # a chain: each ten times the one before
    texts = [" ".join(rng.choices(words, k=40)).title() for _ in range(60)]
    texts += [" ".join(["abcdefn"] * 3 + ["abcdefna"] * 40 + ["abcdefnab"] * 600), "abcdefnab-" * 300, "Ünïcode×÷ÿaaa " * 4, "漢字abcdefgh漢" * 3]
    texts += odd_texts()
    docs = documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, texts[0]), (1, texts[1])]
    more = spark.createDataFrame(rows[-2:], "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'a' source", "1L n_chars")
    got = st.variants(with_clashes(docs.unionAll(more)), block=16).collect()
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in got)
    assert got == brute(rows)
    assert any(r[1] and r[2] != r[1] for r in got) and heavy[0] in {r[0] for r in got}


def test_empty_tables(spark):
    docs = documents(spark, odd_texts())
    assert st.variants(empty(docs)).count() == 0
    assert st.variants(documents(spark, [None, "", "short words only"])).count() == 0
