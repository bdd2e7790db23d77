"""A worker that goes from one operator to the next holds one memo at a time."""

import gc
import weakref

from sparkredact.llm import shingles, token_ids
from sparkredact.llm.queries import tokenizer_path


def test_a_memo_is_kept_until_the_next_operator():
    first = shingles.shingle_set(b"one two three four five six").tolist()
    words = shingles.word_hashes()
    assert words is shingles.word_hashes() and len(words) >= 6
    gone = weakref.ref(words)
    del words
    coder = token_ids.token_ids(tokenizer_path("word_bpe_49k.json"))
    gc.collect()
    assert gone() is None and coder is token_ids.token_ids(tokenizer_path("word_bpe_49k.json"))
    ids = coder.ids("one two three")
    assert shingles.shingle_set(b"one two three four five six").tolist() == first
    assert token_ids.token_ids(tokenizer_path("word_bpe_49k.json")).ids("one two three") == ids
