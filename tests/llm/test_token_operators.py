import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkredact.llm import elias_fano, sos_packing
from sparkredact.llm.queries import tokenizer_path
from sparkredact.llm.token_ids import TokenIds, token_ids
from tests.llm.fixtures import documents, empty, odd_texts, with_clashes

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def whole(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@pytest.mark.parametrize("name", FILES)
def test_cut_texts_have_the_ids_of_whole_texts(name):
    coder = token_ids(tokenizer_path(name), 50)
    odd = ["a  b", "a\n\n b\t\tc \n", "\x1cfoo\x1dbar \x1f", "<|endoftext|> hi<|endoftext|>x", "ΟΔΥΣΣΕΎΣ ΣΑΣ", "é ́a", "İstanbul ẞ",
           "don't  'S we'LL", "日本語 テスト", "a b　c", "x​y", "1234567 3.14", "It's, 'tis. (x),. y", "naïve, café!", "²µªº Àß"]
    for text in [t for t in odd_texts() if t] + odd:
        assert np.array_equal(np.frombuffer(coder.ids(text), "<u4"), whole(name, text)[:-1]), text[:40]
    assert len(coder) <= 50


@pytest.mark.parametrize("name", FILES)
def test_words_before_symbols_have_the_ids_of_whole_texts(name):
    coder = token_ids(tokenizer_path(name), 60)
    for text in ["oieuxé$$$ ab%%% x#1 y2z", "a'sfoo b'll c's", "http://www.example.com/ab?c=d", "x_y z^2 `q` {r} [s] ~t~ é@ü.ch", "aªb$ cµ% dº1", "a\u0301$ é\u0301% i\u0307#"]:
        assert np.array_equal(np.frombuffer(coder.ids(text), "<u4"), whole(name, text)[:-1]), text


def test_memo_keeps_cuts_that_recur(monkeypatch):
    coder = TokenIds(tokenizer_path("byte_bpe_50k.json"), False, 20)
    met = []
    monkeypatch.setattr(coder, "encoded", lambda cut, f=coder.encoded: met.append(cut) or f(cut))
    for i in range(200):
        coder.ids("often " + "".join(chr(97 + int(d)) for d in str(i)) + "q")
        assert len(coder) <= 20 and len(coder.older) <= 20
    assert met.count("often") == 1 and len(met) == 201
    # A word before symbols is a cut of its own, as it is before white space.
    met.clear()
    coder.ids("often$$$ often%%%")
    assert "often" not in met and " often%%%" not in met


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 700):
        for top in (1, 5, 1000):
            ends = np.cumsum(rng.integers(0, top, n))
            read = elias_fano.Ends(n, *elias_fano.encode_ends(ends))
            assert np.array_equal(read.all(), ends)
            assert [read.select(i) for i in range(n)] == ends.tolist()
    low_bits, low, high = elias_fano.encode_ends(np.arange(1, 10_001) * 400)
    assert len(low) + len(high) < 0.2 * 8 * 10_000
    with pytest.raises(IndexError):
        read.select(n)


def test_files_give_back_every_document(spark):
    docs = with_clashes(documents(spark, odd_texts()))
    docs = docs.unionAll(docs.where("doc_id = 5")).unionAll(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    found = elias_fano.encode_documents(docs, tokenizer_path(FILES[0]), segment_ids=50).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    found.sort(key=lambda r: r.start)
    start = 0
    assert len(found) == len(rows)
    for row, got in zip(rows, found):
        ids = whole(FILES[0], row.text)
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert elias_fano.encode_documents(empty(docs), tokenizer_path(FILES[0])).count() == 0


def test_levels_take_the_least_sum_of_squares():
    rng = np.random.default_rng(2)
    levels = sos_packing.Levels(16)
    for i in range(400):
        size = int(rng.integers(1, 16))
        before = levels.count.copy()
        def squares(h):
            c = before.copy()
            if h:
                c[h] -= 1
            c[h + size] += 1
            c[16] = 0
            return int((c * c).sum())
        options = [0, *(h for h in range(1, 17 - size) if before[h])]
        level = levels.best_level(size)
        assert level in options and squares(level) == min(map(squares, options))
        levels.place((i, 0, b"1234" * size, size))
        assert levels.open == levels.count.sum()


@pytest.mark.parametrize("window", [16, 4096])
def test_packing_keeps_every_id_once(spark, window):
    docs = with_clashes(documents(spark, odd_texts()))
    pieces = sos_packing.pack(docs, tokenizer_path(FILES[1]), window=window, max_open=7).toPandas()
    for row in docs.select("doc_id", "text").collect():
        own = pieces[pieces.doc_id == row.doc_id].sort_values("start")
        ids = whole(FILES[1], row.text)
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert np.array_equal(np.concatenate([np.frombuffer(b, "<u4") for b in own.ids]), ids)
        assert all(zlib.crc32(b) == c for b, c in zip(own.ids, own.ids_crc32))
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        total = own.length.sum()
        assert total <= window and (total == window or total & (total - 1) == 0)
    assert sos_packing.pack(empty(docs), tokenizer_path(FILES[1])).count() == 0
