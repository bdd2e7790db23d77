import random

import numpy as np
from pyspark.sql import functions as F

from sparkredact.llm import language_bitmask as lb
from tests.llm.fixtures import documents, empty, odd_texts, with_clashes

SYLLABLES = {"aa": ["the", "ing", "and", "ton"], "bb": ["der", "ung", "ich", "sch"], "cc": ["éau", "oux", "ité", "ent"], "dd": ["ñas", "ción", "los", "est"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(spark, n=400):
    rng = random.Random(5)
    rows = [(i, text(lang := "aabbccdd"[2 * (i % 4):2 * (i % 4) + 2], rng.randrange(3, 60), rng), lang) for i in range(n)]
    rows += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "123 !", "cc"), (n + 3, text("aa", 20, rng), None), (None, text("bb", 20, rng), "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_documents(spark):
    docs = corpus(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = lb.train(with_clashes(docs).where(~held))
    assert sorted(model.languages) == ["aa", "bb", "cc", "dd"] and (model.by_chance < 0.01).all()
    found = {r.doc_id: r for r in lb.identify(with_clashes(docs), model).collect()}
    true = {r.doc_id: r for r in docs.withColumn("held", held).collect()}
    tried = [d for d in true if d is not None and d < 400 and true[d].held]
    assert len(tried) > 60 and sum(found[d].lang_pred == true[d].lang for d in tried) >= 0.97 * len(tried)
    assert [(found[d].lang_pred, found[d].score) for d in (400, 401, 402)] == [("und", 0.0)] * 3
    assert found[403].lang_pred == "aa" and found[None].lang_pred == "bb"


def test_odd_texts_repeats_and_nothing_learned(spark):
    docs = corpus(spark)
    model = lb.train(docs)
    odd = documents(spark, odd_texts() + ["漢字かな", "²½", "_"])
    rows = lb.identify(odd.unionAll(odd.where("doc_id = 5")), model).collect()
    assert len(rows) == len(odd_texts()) + 4 and all(0 <= r.score <= 1 for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 5}) == 1
    by = {r.doc_id: r.lang_pred for r in rows}
    n = len(odd_texts())
    assert by[n] == model.languages[0] and by[n + 1] == by[n + 2] == "und"
    none = lb.train(empty(docs))
    assert {r.lang_pred for r in lb.identify(docs, none).collect()} == {"und"}
    assert lb.identify(empty(docs), model).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    t = " ".join(["Straße, naïve", "l'été 12", "ab c"] * 50)
    whole = sorted(np.concatenate(list(lb.grams(t, (3, 4)))).tolist())
    for step in (1, 2, 5, 64):
        monkeypatch.setattr(lb, "_STEP", step)
        assert sorted(np.concatenate(list(lb.grams(t, (3, 4)))).tolist()) == whole
    # Every n-gram inside a word with its ends, none across words.
    words = "".join(c if c.isalpha() else " " for c in t).split()
    assert len(whole) == sum(max(len(w) + 2 - k + 1, 0) for w in words for k in (3, 4))


def test_filters_hold_all_learned_grams_of_many_languages(spark):
    """More than 64 languages take a second word a row; no filter misses an n-gram put into it."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, own = [], {}
    for i in range(70):
        own[f"l{i:02}"] = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(5)]
        rows += [(j, " ".join(rng.choices(own[f"l{i:02}"], k=30)), f"l{i:02}") for j in range(3)]
    model = lb.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.rows.shape[1] == 2
    for lang, found in own.items():
        for word in found:
            grams = np.concatenate(list(lb.grams(word, model.sizes)))
            if any(word in r[1] for r in rows if r[2] == lang):
                assert model.hits(grams)[model.languages.index(lang)] >= len(grams) - 1
        assert model.judge(" ".join(found))[0] == lang


def test_counts_are_corrected_for_chance():
    """A filter full to nine tenths hits what it doesn't hold; the other language holds all of it."""
    rng = np.random.default_rng(2)
    table = (rng.random(4096) < 0.9).astype(np.uint64)[:, None]
    text = "eins zwei drei vier fünf"
    found = np.concatenate(list(lb.grams(text, (3, 4))))
    low, high = found & 0xFFFFFFFF, (found >> 32) & 0xFFFFFFFF | 1
    for i in range(2):
        table[(low + i * high) % 4096] |= np.uint64(2)
    fill = np.array([(table & np.uint64(1)).mean(), (table >> np.uint64(1)).mean()])
    assert lb.Model(["full", "own"], table, 2, fill ** 2, (3, 4)).judge(text)[0] == "own"
